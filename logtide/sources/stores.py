"""Store URLs and their options."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlsplit

SCHEMES = {"s3": "s3a", "gs": "gs", "file": "file", "memory": None, "null": None}
SIZES = {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30}
TIMES = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
#: Known options by how their values are read.
OPTIONS = {
    "coalesce_bytes": "size", "coalesce_linger": "time", "coalesce_batches": "int", "prefix_compact_segments": "int", "prefix_compact_bytes": "size", "prefix_compact_keep": "int", "maintenance_recency": "time",
    "flush_max_elapsed": "time", "batch_min_size": "size", "batch_max_delay": "time", "auto_create_topics": "bool", "auto_create_partitions": "int",
}
DEPRECATED = frozenset("lease_ttl lease_renew lease_mode writer_lease coalesce legacy_records compact_records".split())


@dataclass
class Store:
    scheme: str
    path: str
    options: dict = field(default_factory=dict)

    @property
    def url(self) -> str | None:
        """For Hadoop file systems; None for the ones that keep nothing on disk."""
        kind = SCHEMES[self.scheme]
        return f"{kind}://{self.path}" if kind else None


def size_of(text: str) -> int:
    """Bytes of a literal such as 4m."""
    m = re.fullmatch(r"(\d+)([bkmg]?)", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) * SIZES[m[2]]


def time_of(text: str) -> int:
    """Milliseconds of a literal such as 250ms."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text.strip().lower())
    if not m:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * TIMES[m[2]]


def _bool(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ValueError(f"not true or false: {text}")
    return text.lower() == "true"


READ = {"size": size_of, "time": time_of, "int": int, "bool": _bool}


def parse(url: str) -> Store:
    """A store from its URL. Values that can't be read are left out with a warning, as are deprecated keys; an unknown scheme is an error."""
    parts = urlsplit(url)
    if parts.scheme not in SCHEMES:
        raise ValueError(f"unknown store: {parts.scheme or url}")
    out = Store(parts.scheme, parts.netloc + parts.path)
    for key, value in parse_qsl(parts.query, keep_blank_values=True):
        if key in DEPRECATED:
            warnings.warn(f"{key} has no effect any more", DeprecationWarning, stacklevel=2)
        elif key not in OPTIONS:
            warnings.warn(f"unknown option {key}", stacklevel=2)
        else:
            try:
                out.options[key] = READ[OPTIONS[key]](value)
            except ValueError as e:
                warnings.warn(f"{key}: {e}", stacklevel=2)
    return out
