"""Policies: rules of all enabled policies that apply to a request; a matching deny is a violation, allow does nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ("tenant_id", "group_id", "user_id", "agent_id")


class PolicyViolation(Exception):
    """A request that a policy denies."""


def evaluate(requests: DataFrame, policies: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Requests (key, scope ids, action, metadata map) with allowed and the ids of the policies they violate.

    policies: id, scope ids (NULL: any), action, effect, conditions map; a table of settings, broadcast up to `most` rows."""
    deny = policies.where("effect = 'deny'")
    if deny.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} denying policies")
    p = deny.select(*(F.col(c).alias(f"p_{c}") for c in deny.columns))
    fits = F.col("action") == F.col("p_action")
    for c in SCOPE:
        if c in requests.columns and c in deny.columns:
            fits = fits & (F.col(f"p_{c}").isNull() | (F.col(f"p_{c}") == F.col(c)))
    holds = F.forall(F.map_entries(F.coalesce("p_conditions", F.expr("cast(map() as map<string,string>)"))), lambda e: F.coalesce(F.element_at(F.col("metadata"), e["key"]) == e["value"], F.lit(False)))
    hit = requests.join(F.broadcast(p), fits & holds, "left")
    return hit.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("p_id")), ",").alias("violations")).select(key, (F.col("violations") == "").alias("allowed"), F.nullif("violations", F.lit("")).alias("violations"))


def enforce(requests: DataFrame, policies: DataFrame, key: str) -> None:
    bad = evaluate(requests, policies, key).where("NOT allowed").limit(20).collect()
    if bad:
        raise PolicyViolation("; ".join(f"{r[key]}: {r['violations']}" for r in bad))
