"""URL filter: allow and block rules, then gradient-boosted trees on lexical features (native).

Rules fit a host and all its subdomains where the path starts with the rule's; the longest that fits decides.
Other URLs are judged by boosted trees trained on labelled URLs. Training runs as DataFrame aggregates: features
are binned at quantiles, each level of each tree is one pre-aggregated histogram of (leaf, feature, bin), whose
gradient sums are integers (millionths), so that results don't depend on the order of addition. A trained tree
is a CASE expression over columns; scoring is a projection after the join with the rates of suffixes.

The trees learn from at most SAMPLE labelled URLs, the first by hash. The label rates of suffixes, and of all, are
counted over all labelled URLs into a stored table with a row a suffix. It joins without a hint: both sides are
tables, so adaptive execution splits the rows of a hot suffix.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
trees; with no labelled URL everything is allowed; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

SAMPLE, TREES, DEPTH, BINS, RATE, PRIOR, UNIT = 20_000, 12, 3, 16, 0.3, 20.0, 1_000_000
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "hyphens", "longest", "secure", "suffix_rate", "suffix_rows")


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. rules: (allow or block, host/path); a short list, as an expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, under = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + under)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """df with host, path, suffix and the lexical features."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = parse(F.col(url_col))
    df = df.withColumn("host", host).withColumn("path", path)
    n = F.length(url)
    # each distinct character's share of the url
    entropy = F.aggregate(F.transform(F.array_distinct(F.split(url, "(?!^)")), lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    count = lambda s, c: F.length(s) - F.length(F.translate(s, c, ""))
    return (
        df.withColumn("length", n.cast("double"))
        .withColumn("depth", count(F.col("path"), "/").cast("double"))
        .withColumn("digits", count(url, string.digits) / F.greatest(n, F.lit(1)))
        .withColumn("entropy", F.round(entropy, 6))
        .withColumn("params", count(url, "?&").cast("double"))
        .withColumn("labels", count(F.col("host"), ".").cast("double"))
        .withColumn("hyphens", count(F.col("host"), "-").cast("double"))
        .withColumn("longest", F.coalesce(F.array_max(F.transform(F.split("host", "\\."), F.length)), F.lit(0)).cast("double"))
        .withColumn("secure", F.lower(url).startswith("https:").cast("double"))
        .withColumn("suffix", suffix_of(F.col("host")))
    )


def suffix_of(host: Column) -> Column:
    """The last three labels of a host; all of them if it has fewer."""
    return F.regexp_extract(host, "([^.]*\\.){0,2}[^.]*$", 0)


def _score(trees: list[list], bias: float) -> Column:
    """The margin: bias and, for each tree, the value of the leaf that the features lead to."""
    total = F.lit(bias)
    for tree in trees:
        total = total + _leaf(tree, 1)
    return total


def _leaf(tree: dict, node: int) -> Column:
    if "split" not in tree[node]:
        return F.lit(tree[node]["value"])
    f, edge = tree[node]["split"]
    return F.when(F.col(f) <= edge, _leaf(tree, 2 * node)).otherwise(_leaf(tree, 2 * node + 1))


def _node(tree: dict, node: int = 1) -> Column:
    if "split" not in tree[node]:
        return F.lit(node)
    f, edge = tree[node]["split"]
    return F.when(F.col(f) <= edge, _node(tree, 2 * node)).otherwise(_node(tree, 2 * node + 1))


def _bin(f: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < f))


def train(rows: DataFrame) -> Column:
    """Boosted trees on rows (the features and y, 1 for block); returns the margin over feature columns."""
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not ones or ones == n:
        return F.lit(-10.0 if not ones else 10.0)
    bias = math.log(ones / (n - ones))
    cuts = rows.agg(*(F.percentile(f, [k / BINS for k in range(1, BINS)]).alias(f) for f in FEATURES)).first().asDict()  # exact, of SAMPLE rows
    cuts = {f: sorted(set(v)) for f, v in cuts.items()}
    # a row's bin of each feature: how many cuts lie below it
    bins = F.array(*(_bin(F.col(f), cuts[f]) for f in FEATURES))
    binned = base.store(rows.withColumn("bins", bins).coalesce(4), "url-bins")
    trees: list[dict] = []
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-_score(trees, bias)))
        graded = binned.select("bins", *FEATURES, F.round((p - F.col("y")) * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * UNIT).cast("long").alias("h"))
        tree: dict = {1: {}}
        for depth in range(DEPTH + 1):
            open_ = [k for k in tree if k.bit_length() == depth + 1]
            if not open_:
                break
            sums: dict[int, dict] = {k: {} for k in open_}
            at = graded.withColumn("node", _node(tree)).where(F.col("node").isin(open_)).select("node", "g", "h", F.posexplode("bins").alias("f", "bin"))
            for r in at.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():  # nodes x features x bins at most
                sums[r["node"]].setdefault(r["f"], {})[r["bin"]] = (r["g"] / UNIT, r["h"] / UNIT, r["n"])
            for k in open_:
                every = sums[k].get(0, {}).values()
                g, h = sum(x[0] for x in every), sum(x[1] for x in every)
                tree[k]["value"] = -RATE * g / (h + PRIOR / 20)
                if depth == DEPTH or not every:
                    continue
                best = (1e-3, None)
                for f in sorted(sums[k]):
                    lg = lh = 0.0
                    for b in sorted(sums[k][f])[:-1]:
                        lg, lh = lg + sums[k][f][b][0], lh + sums[k][f][b][1]
                        gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                        if lh > 1 and h - lh > 1 and gain > best[0] + 1e-9 and b < len(cuts[FEATURES[f]]):
                            best = (gain, (FEATURES[f], cuts[FEATURES[f]][b]))
                if best[1]:
                    tree[k]["split"] = best[1]
                    tree[2 * k], tree[2 * k + 1] = {}, {}
        trees.append(tree)
    return _score(trees, bias)


def with_suffixes(df: DataFrame, stats: DataFrame, prior: float, own: Column | None = None) -> DataFrame:
    """df with the smoothed label rate of its host's suffix and the rows behind it (without its own label, in training)."""
    n, s = F.coalesce("__n", F.lit(0)), F.coalesce("__s", F.lit(0))
    if own is not None:
        n, s = n - 1, s - own
    return df.join(stats, "suffix", "left").withColumn("suffix_rate", F.round((s + prior * PRIOR) / (n + PRIOR), 6)).withColumn("suffix_rows", n.cast("double")).drop("__n", "__s")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", at: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and score (the trees' chance of block) of every url.

    labelled: url and y (1: block)."""
    labelled = base.store(labelled.where(F.col("url").isNotNull() & F.col("y").isNotNull()).select("url", F.col("y").cast("int").alias("y")), "url-labelled")
    sample = base.store(lexical(labelled.orderBy(F.xxhash64("url"), "url", "y").limit(SAMPLE), "url"), "url-sample")
    stats = labelled.groupBy(suffix_of(parse(F.col("url"))[0]).alias("suffix")).agg(F.count("*").alias("__n"), F.sum("y").alias("__s"))
    stats = base.store(stats, "url-suffixes")
    n, ones = stats.agg(F.sum("__n"), F.sum("__s")).first()
    prior = ones / n if n else 0.0
    margin = train(with_suffixes(sample, stats, prior, F.col("y")))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    scored = with_suffixes(lexical(own, "url"), stats, prior).withColumn("score", 1 / (1 + F.exp(-margin)))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= at, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
