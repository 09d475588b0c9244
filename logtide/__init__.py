"""Analytics for append-only, partitioned event logs as DataFrame and Structured Streaming queries."""
