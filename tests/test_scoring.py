import math

import pytest
from pyspark.sql import functions as F

from oremill.functions import scoring as S
from oremill.functions import text as X
from oremill.functions.temporal import active_at, active_between, may_move, overlaps
from oremill.functions.vector import cosine


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_calibration(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, S.calibrate_semantic(lit(0.425))) == pytest.approx(0.5)
    assert one(spark, S.calibrate_semantic(lit(0.9))) == 1.0
    assert one(spark, S.calibrate_semantic(lit(-0.1))) == 0.0
    assert one(spark, S.calibrate_semantic(lit(None))) is None
    assert one(spark, S.normalize_rrf(lit(2 / 61), 2)) == pytest.approx(1.0)
    assert one(spark, S.normalize_rrf(lit(1.0), 0)) == 0.0
    assert one(spark, S.normalize_ppr(lit(0.0081))) == pytest.approx(0.3)
    assert one(spark, S.normalize_ppr(lit(float("nan")))) == 0.0


def test_null_is_not_zero(spark):
    yes, no, none = F.lit(0.8), F.lit(0.0), F.lit(None).cast("double")
    assert one(spark, S.composite([(0.55, yes), (0.45, none)])) == pytest.approx(0.8)
    assert one(spark, S.composite([(0.55, yes), (0.45, no)])) == pytest.approx(0.44)
    assert one(spark, S.composite([(0.55, none), (0.45, none)])) == 0.0


def test_weights():
    assert S.default_weights({"semantic", "keyword", "graph", "memory"}) == {"semantic": 0.35, "keyword": 0.05, "graph": 0.30, "memory": 0.30}
    assert S.default_weights({"graph"}) == {"graph": 1.0}
    assert all(sum(w.values()) == pytest.approx(1) for w in S.DEFAULT_WEIGHTS.values())
    assert S.runner_weights({"semantic": 0.4, "keyword": 0.2})["indexed"] == pytest.approx(0.6)


def test_decay(spark):
    week = 7 * 86_400_000
    assert one(spark, S.decay_score(F.lit(week), F.lit(1.0), F.lit(99))) == pytest.approx(0.4 * 0.5 + 0.4 + 0.2)
    assert one(spark, S.recency(F.lit(2 * week))) == pytest.approx(0.25)
    assert one(spark, S.decay_score(F.lit(-5), F.lit(2.0), F.lit(None).cast("int"))) == pytest.approx(0.8)


def test_sets(spark):
    assert one(spark, S.trigram_jaccard(F.lit("abcd"), F.lit("abce"))) == pytest.approx(1 / 3)
    assert one(spark, S.trigram_jaccard(F.lit("ab"), F.lit("ab"))) == 0.0
    assert one(spark, S.overlap_coefficient(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0
    assert one(spark, S.entity_chunk_weight(F.lit(3), F.lit(0.0))) == pytest.approx(min(3, 0.5 + 2 * 0.75))


def test_text(spark):
    assert X.relaxed_terms('the "red fox" and fox of it') == ["red fox", "red", "fox"]
    assert X.fold_text("Æsop Café-Été") == "aesop cafe ete"
    assert one(spark, X.sanitize_predicate(F.lit(" works-at!  now "))) == "WORKS_AT_NOW"
    assert one(spark, X.estimate_tokens(F.lit("a b  c"))) == math.ceil(3.9)
    assert one(spark, X.strip_markdown(F.lit("# A\n\n\n\n**b** `c` [d](e)\n- f"))) == "A\n\nb c d\nf"
    assert one(spark, X.idempotency_key(F.lit("a"), F.lit(None).cast("string"))) == "a::"
    assert len(one(spark, X.idempotency_key(F.lit("a" * 200)))) == 64
    assert one(spark, X.sanitize(F.lit("a\x00b\x01c\n"))) == "ab c\n"
    assert [r[0] for r in spark.createDataFrame([("Ökonomie",), (None,)], "s string").select(X.fold("s")).collect()] == ["okonomie", None]


def test_time(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert one(spark, active_at(t("2024-01-01"), t("2024-01-01"), t("2024-01-02")))
    assert not one(spark, active_at(t("2024-01-02"), t("2024-01-01"), t("2024-01-02")))
    assert one(spark, active_between(t("2024-01-02"), t("2024-01-03"), t("2024-01-01"), none))
    assert not one(spark, overlaps(t("2024-01-01"), t("2024-01-02"), t("2024-01-02"), none))
    assert one(spark, may_move(F.lit("archived"), F.lit("active"))) and not one(spark, may_move(F.lit("expired"), F.lit("active")))


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    for dims in (None, 2):
        assert one(spark, cosine(a, b, dims)) == pytest.approx(math.sqrt(0.5))
    assert one(spark, cosine(F.array(F.lit(0.0), F.lit(0.0)), b)) == 0.0
