"""Access rules and client quotas."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import user_of

# What else an allowed operation permits.
IMPLIED = {"DESCRIBE": ("READ", "WRITE", "DELETE", "ALTER"), "DESCRIBE_CONFIGS": ("ALTER_CONFIGS",)}
ANY, MATCH = "ANY", "MATCH"
QUOTA_KEYS = ("producer_byte_rate", "consumer_byte_rate", "request_rate")
BURST_S, DEBT_S, WAIT_S = 1.0, 60.0, 10.0


def selects(rule: str, kind: Column, name: Column) -> Column:
    """Whether a rule is about a resource: by its name, by ``*``, or by a prefix."""
    r = lambda c: F.col(f"{rule}.{c}")
    literal = (r("pattern") == "LITERAL") & ((r("resource_name") == name) | (r("resource_name") == "*"))
    return (r("resource_type") == kind) & (literal | ((r("pattern") == "PREFIXED") & F.startswith(name, r("resource_name"))))


def covers(rule: str, operation: Column) -> Column:
    return (F.col(f"{rule}.operation") == "ALL") | (F.col(f"{rule}.operation") == operation)


def grants(rule: str, operation: Column) -> Column:
    """An allowing rule also grants what its operation implies."""
    more = [(operation == to) & F.col(f"{rule}.operation").isin(*by) for to, by in IMPLIED.items()]
    out = covers(rule, operation)
    for m in more:
        out = out | m
    return out


def decide(requests: DataFrame, acls: DataFrame, super_users: Iterable[str] = ()) -> DataFrame:
    """Adds ``allowed`` to requests (request_id, principal, host, resource_type, resource_name, operation).

    Any matching denial wins; else one matching permission is enough; else no. Super users always may.
    Rules are joined on the principal and resource type, then their patterns are a residual: requests are
    never paired with rules of other principals.
    """
    q = requests.alias("q")
    asked = requests.select("request_id", "principal", "host", "resource_type", "resource_name", "operation", F.explode(F.array("principal", F.lit("User:*"))).alias("_p")).distinct().alias("a")
    rules = acls.distinct().alias("r")
    host = (F.col("r.host") == "*") | (F.col("r.host") == F.col("a.host"))
    on = (F.col("a._p") == F.col("r.principal")) & selects("r", F.col("a.resource_type"), F.col("a.resource_name")) & host
    found = asked.join(rules, on).groupBy("a.request_id").agg(
        F.bool_or((F.col("r.permission") == "DENY") & covers("r", F.col("a.operation"))).alias("_deny"), F.bool_or((F.col("r.permission") == "ALLOW") & grants("r", F.col("a.operation"))).alias("_allow")
    )
    ruled = ~F.coalesce("_deny", F.lit(False)) & F.coalesce("_allow", F.lit(False))
    supers = list(super_users)
    allowed = (F.col("q.principal").isin(*supers) | ruled) if supers else ruled
    return q.join(found, "request_id", "left").select("q.*", allowed.alias("allowed"))


def acl_filter(acls: DataFrame, *, resource_type: str = ANY, resource_name: str | None = None, pattern: str = ANY, principal: str | None = None, host: str | None = None, operation: str = ANY, permission: str = ANY) -> DataFrame:
    """Rules that a filter describes; pattern MATCH asks for all rules that would select the name."""
    out = acls
    for column, wanted in (("resource_type", resource_type), ("operation", operation), ("permission", permission)):
        out = out if wanted == ANY else out.filter(F.col(column) == wanted)
    for column, wanted in (("principal", principal), ("host", host)):
        out = out if wanted is None else out.filter(F.col(column) == wanted)
    if pattern == MATCH:
        if resource_name is not None:
            name = F.lit(resource_name)
            literal = (F.col("pattern") == "LITERAL") & F.col("resource_name").isin(resource_name, "*")
            out = out.filter(literal | ((F.col("pattern") == "PREFIXED") & F.startswith(name, F.col("resource_name"))))
        return out
    out = out if pattern == ANY else out.filter(F.col("pattern") == pattern)
    return out if resource_name is None else out.filter(F.col("resource_name") == resource_name)


def create_acls(acls: DataFrame, new: DataFrame) -> DataFrame:
    """The rules with new ones; those that exist already are no error and change nothing."""
    return acls.unionByName(new.select(*acls.columns)).distinct()


def delete_acls(acls: DataFrame, **wanted) -> tuple[DataFrame, DataFrame]:
    """The rules left, and the rules that a filter deleted."""
    gone = acl_filter(acls, **wanted)
    return acls.exceptAll(gone), gone


def effective_quotas(users: DataFrame, quotas: DataFrame, replicas: int = 1) -> DataFrame:
    """Limits of each principal, key by key its own or else the default's, divided between replicas."""
    default = quotas.filter("entity_user is null").agg(*(F.max(k).alias(f"_d_{k}") for k in QUOTA_KEYS))  # one row
    own = quotas.filter("entity_user is not null")
    rows = users.withColumn("_u", user_of("principal")).join(own, F.col("_u") == F.col("entity_user"), "left").crossJoin(F.broadcast(default))
    return rows.select("principal", *((F.coalesce(k, f"_d_{k}") / replicas).alias(k) for k in QUOTA_KEYS))


def alter_quotas(quotas: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies changes (position, entity_user, key, value; a null value removes the key).

    All changes of an entity apply or none does: an unknown key, a negative or an infinite value refuses
    them. An entity without a key left is gone. Returns the quotas and a refused flag for each entity.
    """
    bad = ~F.col("key").isin(*QUOTA_KEYS) | F.coalesce((F.col("value") < 0) | F.isnan("value") | (F.col("value") == float("inf")), F.lit(False))
    judged = changes.groupBy("entity_user").agg(F.bool_or(bad).alias("refused"))
    last = changes.groupBy("entity_user", "key").agg(F.max_by(F.struct("value"), "position").alias("_l"))
    wide = last.groupBy("entity_user").agg(*(F.max(F.when(F.col("key") == k, F.struct(F.col("_l.value").alias("v")))).alias(f"_c_{k}") for k in QUOTA_KEYS)).join(judged.withColumnRenamed("entity_user", "_e"), F.col("entity_user").eqNullSafe(F.col("_e")))
    wide = wide.filter("not refused").drop("refused", "_e").withColumnRenamed("entity_user", "_n")
    joined = quotas.withColumn("_q", F.lit(True)).join(wide.withColumn("_w", F.lit(True)), F.col("entity_user").eqNullSafe(F.col("_n")), "full")
    name = F.when(F.col("_q"), F.col("entity_user")).otherwise(F.col("_n"))
    out = joined.select(name.alias("entity_user"), *(F.when(F.col(f"_c_{k}").isNotNull(), F.col(f"_c_{k}.v")).otherwise(F.col(k)).alias(k) for k in QUOTA_KEYS))
    return out.filter(F.coalesce(*QUOTA_KEYS).isNotNull()), judged


def describe_quotas(quotas: DataFrame, *, user: str | None = None, default: bool = False, strict: bool = False) -> DataFrame:
    """Stored limits of one user, of the default, or of all; ``strict`` leaves out entities no component names."""
    if user is not None:
        return quotas.filter(F.col("entity_user") == user)
    if default:
        return quotas.filter(F.col("entity_user").isNull())
    return quotas.filter(F.lit(not strict))


def charge(tokens: float, last: float, now: float, rate: float, cost: float) -> tuple[float, float]:
    """A token bucket after a cost: tokens left, and seconds to wait.

    It holds a second's worth; its debt is at most a minute's; a wait is at most ten seconds. At rate 0 every
    cost waits as long as a wait can be.
    """
    if rate <= 0:
        return 0.0, WAIT_S if cost > 0 else 0.0
    tokens = min(rate * BURST_S, tokens + max(0.0, now - last) * rate) - cost
    tokens = max(tokens, -rate * DEBT_S)
    return tokens, min(WAIT_S, max(0.0, -tokens / rate))


def throttle(charges: DataFrame) -> DataFrame:
    """Adds ``wait_s`` to charges (principal, at_s, cost, rate) in order of time: each principal is a fold.

    Clamping makes each step depend on the one before. Charges are small rows, one stream a principal.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at_s", "cost"], ignore_index=True)
        tokens, last, out = math.inf, 0.0, []
        for at, cost, rate in zip(group["at_s"], group["cost"], group["rate"]):
            tokens, wait = charge(tokens, last, at, rate, cost)
            last = at
            out.append(wait)
        group["wait_s"] = out
        return group

    return charges.select("principal", "at_s", "cost", "rate").groupBy("principal").applyInPandas(fold, "principal string, at_s double, cost double, rate double, wait_s double")
