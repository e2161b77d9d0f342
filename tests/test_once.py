"""Text and confidence expressions that are evaluated once per row."""

import random

from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators.curate import flatten_qa
from quillmill.operators.metrics import reliability_bins


def test_white_space_at_the_ends_and_the_first_words_as_in_python(spark):
    spaces = text.SPACES
    assert sorted(spaces) == sorted(c for c in map(chr, range(0x3100)) if c.isspace())
    rng = random.Random(2)
    texts = ["", " ", "a", " a", "a ", "​a​", "\x00 a \x00", "\U0001f600 b 　", None]
    texts += ["".join(rng.choice(spaces + "abé中") for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    rows = df.select("t", text.strip(t).alias("s"), text.first_words(t, 3).alias("w"),
                     text.first_words(t, F.lit(3)).alias("v")).collect()
    for r in rows:
        assert r.s == (r.t or "").strip()
        assert r.w == r.v == " ".join((r.t or "").split()[:3])


def test_words_of_a_context_are_counted_once(spark):
    """A filter on the count, or on a confidence, is not evaluated on a copy of its expression."""
    records = spark.range(3).select(
        F.col("id").alias("sample_id"), F.col("id").cast("string").alias("context"),
        F.lit("Governing Law").alias("question"), F.struct(F.array(F.lit("x")).alias("text")).alias("answers"))
    plan = flatten_qa(records)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("split(" in line for line in filters)
    rows = spark.range(9).select(
        F.lit("m").alias("model_tag"), F.lit(1.0).alias("accurate"), F.exp(-F.col("id") / 7).alias("confidence"))
    plan = reliability_bins(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") == 1
