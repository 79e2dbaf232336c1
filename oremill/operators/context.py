"""Context assembly: names, budgets and text for what a search returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default budgets, in tokens.
BUDGETS = {"total": 30_000, "facts": 1_500, "entities": 1_500}
SECTIONS = ("chunks", "facts", "entities", "memories")


def hydrate(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of their ends; an unknown end keeps its id."""
    names = entities.select("id", "name")
    out = edges.join(names.toDF("source", "__s"), "source", "left").join(names.toDF("target", "__t"), "target", "left")
    return out.withColumn("source_name", F.coalesce("__s", "source")).withColumn("target_name", F.coalesce("__t", "target")).drop("__s", "__t")


def within_budget(entries: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """Entries in order until the first that overflows; the first is always kept. `used` is the running sum.

    Token counts aren't negative, so the running sum passes the budget once and for all."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = entries.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return run.where((F.col("__n") == 1) | (F.col("used") <= budget)).drop("__n")


def trim(sections: dict[str, list[tuple[str, int]]], total: int = BUDGETS["total"]) -> dict[str, list[tuple[str, int]]]:
    """Drop entries (text, tokens) from the last non-empty section until all fit or one is left. A short list, on the driver."""
    out = {k: list(v) for k, v in sections.items()}
    while sum(t for v in out.values() for _, t in v) > total and sum(map(len, out.values())) > 1:
        next(out[k] for k in reversed(list(out)) if out[k]).pop()
    return out


def render(sections: dict[str, list[tuple[str, int]]], form: str = "xml") -> str:
    """xml, markdown or plain text of trimmed sections."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    parts = []
    for name, entries in sections.items():
        if not entries:
            continue
        lines = [t for t, _ in entries]
        if form == "xml":
            tag = name.rstrip("s") if name != "entities" else "entity"
            parts.append(f"<{name}>\n" + "\n".join(f"<{tag}>{esc(x)}</{tag}>" for x in lines) + f"\n</{name}>")
        elif form == "markdown":
            parts.append(f"## {name.title()}\n\n" + "\n".join(f"- {x}" for x in lines))
        else:
            parts.append(f"{name.title()}:\n" + "\n".join(lines))
    body = ("\n" if form == "xml" else "\n\n").join(parts)
    return f"<context>\n{body}\n</context>" if form == "xml" else body


def subgraph_text(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """source, text: one line of facts for each source vertex."""
    named = hydrate(edges, entities)
    fact = F.concat_ws(" ", "source_name", F.lower(F.replace("relation", F.lit("_"), F.lit(" "))), "target_name")
    return named.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set(fact)), "; ").alias("text"))
