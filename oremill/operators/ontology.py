"""Relations of the knowledge graph: normal names, direction, symmetry and types. The table is a parameter; this is the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.text import sanitize_predicate

#: The relations.
PREDICATES = (
    "IS_A PART_OF CONTAINS EQUIVALENT_TO RELATED_TO WORKS_FOR WORKS_AS REPORTS_TO MANAGES FOUNDED LEADS ADVISES MEMBER_OF REPRESENTS INVESTED_IN MARRIED DIVORCED PARENT_OF CHILD_OF SIBLING_OF MENTORED "
    "ACQUIRED MERGED_WITH PARTNERED_WITH COMPETES_WITH FUNDED SUPPLIED SUED REGULATED_BY OWNS USES IMPLEMENTS INTEGRATES_WITH REQUIRES COMPATIBLE_WITH MIGRATED_FROM DEPLOYED_AT REPLACES BASED_ON "
    "ASSIGNED_TO BLOCKS DUPLICATES RESOLVES CREATED AUTHORED SIGNED APPROVED REFERENCES DESCRIBES SUPPORTS OPPOSES ATTENDED ORGANIZED SPOKE_AT OCCURRED_AT OCCURRED_IN LOCATED_IN OPERATES_IN HEADQUARTERED_IN "
    "GOVERNS PROHIBITS PERMITS AMENDS REPEALS CAUSED PRECEDED FOLLOWED KILLED BETRAYED RESCUED EXILED_TO RULED CONQUERED IMPRISONED_IN FOUGHT_IN"
).split()
#: Relations without a direction, names that are no relation, and cues of aliases, which never become edges.
SYMMETRIC = "EQUIVALENT_TO RELATED_TO MARRIED DIVORCED SIBLING_OF MERGED_WITH PARTNERED_WITH COMPETES_WITH INTEGRATES_WITH COMPATIBLE_WITH".split()
DISALLOWED = "IS HAS HAS_A MENTIONED".split()
ALIAS_CUES = "KNOWN_AS ALSO_CALLED ALIAS ALIAS_OF AKA CALLED NAMED_AFTER NAMED_FOR".split()
#: Other names of relations that were, and names whose subject and object change places.
FORMER = {
    "WAS_A": "IS_A", "WAS_AN": "IS_A", "WORKED_FOR": "WORKS_FOR", "WORKED_AT": "WORKS_FOR", "WAS_EMPLOYED_BY": "WORKS_FOR", "HELD_ROLE": "WORKS_AS", "HELD_POSITION": "WORKS_AS", "WORKED_AS": "WORKS_AS", "WORKED_AS_A": "WORKS_AS",
    "LED": "LEADS", "HEADED": "LEADS", "CHAIRED": "LEADS", "ADVISED": "ADVISES", "CONSULTED_FOR": "ADVISES", "LIVED_IN": "LOCATED_IN", "RESIDED_IN": "LOCATED_IN", "WITHDREW_FROM": "OPERATES_IN",
}
SWAPPED = {
    "REPRESENTED_BY": "REPRESENTS", "REGULATES": "REGULATED_BY", "OWNED_BY": "OWNS", "PROPERTY_OF": "OWNS", "USED_IN": "USES", "IMPLEMENTED_BY": "IMPLEMENTS", "REQUIRED_BY": "REQUIRES", "REPLACED_BY": "REPLACES",
    "REPORTED_BY": "ASSIGNED_TO", "BLOCKED_BY": "BLOCKS", "RESOLVED_BY": "RESOLVES", "WRITTEN_BY": "AUTHORED", "AMENDED_BY": "AMENDS", "SUCCEEDED_BY": "PRECEDED", "SLAIN_BY": "KILLED",
}
#: Other names, the most used ones; more come by parameter.
ALIASES = {
    "IS_AN": "IS_A", "TYPE_OF": "IS_A", "INSTANCE_OF": "IS_A", "BELONGS_TO": "PART_OF", "INCLUDES": "CONTAINS", "SAME_AS": "EQUIVALENT_TO", "ASSOCIATED_WITH": "RELATED_TO", "WORKS_AT": "WORKS_FOR", "EMPLOYED_BY": "WORKS_FOR",
    "SERVES_AS": "WORKS_AS", "SUPERVISES": "MANAGES", "ESTABLISHED": "FOUNDED", "CO_FOUNDED": "FOUNDED", "COFOUNDED": "FOUNDED", "HEADS": "LEADS", "JOINED": "MEMBER_OF", "BACKED": "INVESTED_IN", "MARRIED_TO": "MARRIED", "SPOUSE_OF": "MARRIED",
    "FATHER_OF": "PARENT_OF", "MOTHER_OF": "PARENT_OF", "SON_OF": "CHILD_OF", "DAUGHTER_OF": "CHILD_OF", "BROTHER_OF": "SIBLING_OF", "SISTER_OF": "SIBLING_OF", "TRAINED": "MENTORED", "COACHED": "MENTORED", "BOUGHT": "ACQUIRED", "PURCHASED": "ACQUIRED",
    "MERGED_INTO": "MERGED_WITH", "COLLABORATED_WITH": "PARTNERED_WITH", "RIVALS": "COMPETES_WITH", "FINANCED": "FUNDED", "DEPENDS_ON": "REQUIRES", "NEEDS": "REQUIRES", "SUPERSEDES": "REPLACES", "DERIVED_FROM": "BASED_ON", "FIXES": "RESOLVES", "CLOSES": "RESOLVES",
    "BUILT": "CREATED", "DEVELOPED": "CREATED", "LAUNCHED": "CREATED", "INVENTED": "CREATED", "WROTE": "AUTHORED", "COMPOSED": "AUTHORED", "PUBLISHED": "AUTHORED", "CITES": "REFERENCES", "MENTIONS": "REFERENCES", "ENDORSED": "SUPPORTS", "CRITICIZED": "OPPOSES",
    "LIVES_IN": "LOCATED_IN", "RESIDES_IN": "LOCATED_IN", "BORN_IN": "LOCATED_IN", "BASED_IN": "HEADQUARTERED_IN", "BANS": "PROHIBITS", "ALLOWS": "PERMITS", "TRIGGERED": "CAUSED", "LED_TO": "CAUSED", "MURDERED": "KILLED", "ASSASSINATED": "KILLED", "SAVED": "RESCUED",
    "CAPTURED": "CONQUERED", "SERVED_IN": "FOUGHT_IN",
}


#: Names that are broadcast, at most.
MOST = 10_000


def rows(extra: list[list[str]] = ()) -> list[tuple[str, str, bool, str | None]]:
    """name, relation, swap, status. A passive (X_BY) of a relation or of another name of it changes places by rule.
    extra: lists of synonyms, the first of each the relation."""
    plain = {p: p for p in PREDICATES} | ALIASES | {a: s[0] for s in extra for a in s}
    out = {k: (k, v, False, None) for k, v in plain.items()}
    out |= {f"{k}_BY": (f"{k}_BY", v, True, None) for k, v in plain.items() if f"{k}_BY" not in plain and not k.endswith(("_BY", "_OF", "_IN", "_AT", "_TO", "_AS", "_ON", "_A", "_AN", "_FOR", "_WITH", "_FROM"))}
    out |= {k: (k, v, True, None) for k, v in SWAPPED.items()} | {k: (k, v, False, "former") for k, v in FORMER.items()}
    return sorted(out.values())


def table(spark: SparkSession, extra: list[list[str]] = ()) -> DataFrame:
    return spark.createDataFrame(rows(extra), "name string, predicate string, swap boolean, temporal_status string")


def normalise(triples: DataFrame, names: DataFrame, column: str = "predicate") -> DataFrame:
    """Triples (subject, <column>, object) with normal relations, swapped where their names say so; valid says whether a relation is known.

    names: a table of an ontology, broadcast up to MOST names; a larger one is joined as tables are."""
    if names.limit(MOST + 1).count() <= MOST:
        names = F.broadcast(names)
    original = sanitize_predicate(F.col(column))
    t = triples.withColumn("original", original).join(names.select(F.col("name").alias("original"), F.col("predicate").alias("__p"), "swap", "temporal_status"), "original", "left")
    cue = F.col("original").isin(*ALIAS_CUES)
    swap = F.coalesce("swap", F.lit(False)) & ~cue
    p = F.when(cue, F.col("original")).otherwise(F.coalesce("__p", "original"))
    return t.select(
        *[c for c in triples.columns if c not in ("subject", "object", column)], F.when(swap, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.when(swap, F.col("subject")).otherwise(F.col("object")).alias("object"),
        "original", p.alias("predicate"), (F.col("__p").isNotNull() & ~cue & ~p.isin(*DISALLOWED)).alias("valid"), p.isin(*SYMMETRIC).alias("symmetric"), "temporal_status",
    )


def types_ok(domain: Column, range_: Column, subject: Column, object_: Column) -> Column:
    """Soft check: an unknown type fits, and so does any type where '*' is allowed."""
    fits = lambda allowed, t: F.array_contains(allowed, "*") | t.isNull() | F.array_contains(allowed, t)
    return fits(domain, subject) & fits(range_, object_)
