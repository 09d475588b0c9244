"""Topics and their configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a topic gets that does not say otherwise.
DEFAULT_POLICY, DEFAULT_RETENTION_MS = "delete", "604800000"
CREATED_PARTITIONS, AUTO_CREATED_PARTITIONS, DEFAULT_REPLICATION = 3, 1, 1
TOPIC_EXISTS, UNKNOWN_TOPIC, UNAUTHORIZED, INVALID_CONFIG = 36, 3, 29, 40


def create_topics(catalog: DataFrame, requests: DataFrame, *, validate_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The catalog after the requests (position, topic, partitions, replication_factor), and a code for each.

    -1 asks for the default. An existing name, or one asked for before, is refused; the others are created.
    """
    there = catalog.select("topic", F.lit(True).alias("_there"))
    again = F.row_number().over(Window.partitionBy("topic").orderBy("position")) > 1
    judged = requests.withColumn("_again", again).join(there, "topic", "left")
    code = F.when(F.coalesce("_there", F.lit(False)) | F.col("_again"), F.lit(TOPIC_EXISTS)).otherwise(F.lit(0))
    judged = judged.withColumn("error_code", code)
    partitions = F.when(F.col("partitions") == -1, F.lit(CREATED_PARTITIONS)).otherwise(F.col("partitions")).cast("int")
    factor = F.when(F.col("replication_factor") == -1, F.lit(DEFAULT_REPLICATION)).otherwise(F.col("replication_factor")).cast("smallint")
    new = judged.filter("error_code = 0").select("topic", F.uuid().alias("topic_id"), partitions.alias("partitions"), factor.alias("replication_factor"), F.unix_millis(F.current_timestamp()).alias("incarnation"))
    after = catalog if validate_only else catalog.unionByName(new)
    return after, judged.select("position", "topic", "error_code").orderBy("position")


def auto_create(catalog: DataFrame, requested: DataFrame, *, broker_allows: bool, client_allows: bool) -> DataFrame:
    """Requested topics that do not exist yet, with one partition; none unless both sides allow it."""
    missing = requested.select("topic").distinct().join(catalog, "topic", "left_anti")
    return missing.filter(F.lit(broker_allows and client_allows)).withColumn("partitions", F.lit(AUTO_CREATED_PARTITIONS))


def delete_topics(catalog: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes by name or id: the catalog left, and a code for each request."""
    named, numbered = catalog.select(F.col("topic").alias("_a")), catalog.select(F.col("topic").alias("_b"), F.col("topic_id").alias("_i"))
    found = requests.join(named, requests.topic == named["_a"], "left").join(numbered, requests.topic_id == numbered["_i"], "left").withColumn("_n", F.coalesce("_a", "_b"))
    codes = found.select("position", F.coalesce("topic", "_n").alias("topic"), F.when(F.col("_n").isNull(), F.lit(UNKNOWN_TOPIC)).otherwise(F.lit(0)).alias("error_code")).orderBy("position")
    return catalog.join(found.filter("_n is not null").select(F.col("_n").alias("topic")).distinct(), "topic", "left_anti"), codes


def with_defaults(configs: DataFrame, topics: DataFrame) -> DataFrame:
    """Configs with a policy and a retention for topics that set none; only topics that delete get a retention.

    Doing it twice changes nothing.
    """
    wide = topics.select("topic").distinct().join(configs.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("c")), "topic", "left")
    c = F.coalesce("c", F.create_map().cast("map<string,string>"))
    policy = F.coalesce(F.element_at(c, "cleanup.policy"), F.lit(DEFAULT_POLICY))
    added = F.when(~F.map_contains_key(c, "cleanup.policy"), F.create_map(F.lit("cleanup.policy"), F.lit(DEFAULT_POLICY))).otherwise(F.create_map().cast("map<string,string>"))
    timed = F.when(F.array_contains(F.split(policy, r"\s*,\s*"), "delete") & ~F.map_contains_key(c, "retention.ms"), F.create_map(F.lit("retention.ms"), F.lit(DEFAULT_RETENTION_MS))).otherwise(F.create_map().cast("map<string,string>"))
    return wide.select("topic", F.explode(F.map_concat(c, added, timed)).alias("name", "value"))


def alter_configs(configs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies SET and DELETE changes (position, topic, name, op, value), the last of a name winning; other operations are refused."""
    good = changes.filter(F.col("op").isin("SET", "DELETE"))
    last = good.groupBy("topic", "name").agg(F.max_by(F.struct("op", "value"), "position").alias("_l"))
    kept = configs.join(last.select("topic", "name"), ["topic", "name"], "left_anti")
    new = last.filter(F.col("_l.op") == "SET").select("topic", "name", F.col("_l.value").alias("value"))
    codes = changes.select("position", "topic", "name", F.when(F.col("op").isin("SET", "DELETE"), F.lit(0)).otherwise(F.lit(INVALID_CONFIG)).alias("error_code")).orderBy("position")
    return kept.unionByName(new), codes


def describe_configs(configs: DataFrame, topic: str, names: list[str] | None = None) -> DataFrame:
    rows = configs.filter(F.col("topic") == topic)
    return rows.filter(F.col("name").isin(*names)) if names is not None else rows


def metadata(catalog: DataFrame, requests: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The catalog, or the requested topics in request order with a code; those a user may not see are named only if asked for by name."""
    if requests is None:
        rows = catalog if allowed is None else catalog.join(allowed, "topic", "left_semi")
        return rows.select("topic", "topic_id", "partitions", F.lit(0).alias("error_code"))
    rows = requests.join(catalog, "topic", "left")
    may = F.lit(True)
    if allowed is not None:
        rows = rows.join(allowed.select("topic", F.lit(True).alias("_may")).distinct(), "topic", "left")
        may = F.coalesce("_may", F.lit(False))
    code = F.when(~may, F.lit(UNAUTHORIZED)).when(F.col("partitions").isNull(), F.lit(UNKNOWN_TOPIC)).otherwise(F.lit(0))
    return rows.select("position", "topic", F.when(may, F.col("topic_id")).alias("topic_id"), F.when(may, F.col("partitions")).alias("partitions"), code.alias("error_code")).orderBy("position")


def cluster(name: str, node: int = 0) -> dict:
    """The one coordinator that answers for the cluster."""
    return {"cluster_id": name, "controller_id": node, "nodes": [node]}
