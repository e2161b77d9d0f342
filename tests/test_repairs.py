"""Many classes, samples by a cut, bounded heads, and the failure map as one plan."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import blocking, metrics, reports, sampling
from quillmill.operators.preference import wrong_class_answers
from quillmill.plans.failures import failure_map


def test_thousands_of_classes_and_none(spark):
    samples = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("c"), F.col("id") % 2500)).alias("class"),
        F.col("id").cast("string").alias("answer"),
    )
    asked = wrong_class_answers(samples, samples.select("id", "class"), "id", "class", "answer")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "strategy=broadcast" not in plan
    of = samples.select(F.col("answer").alias("rejected"), F.col("class").alias("other"))
    rows = samples.join(asked, "id").join(of, "rejected").select("id", "class", "other").collect()
    assert len(rows) == 6000
    assert all(r["class"] != r["other"] for r in rows)
    assert any(r["other"] is None for r in rows) and any(r["class"] is None for r in rows)


def test_one_class_falls_back(spark):
    samples = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "id int, class string, answer string")
    asked = wrong_class_answers(samples, samples.select("id", "class"), "id", "class", "answer")
    assert {r.rejected for r in asked.collect()}.isdisjoint({"a", "b", None})


@pytest.mark.parametrize("n", [0, 1, 7, 50, 51])
def test_sample_is_cut_at_the_nth_key(spark, n):
    rows = spark.range(50).withColumn("text", F.lit("x"))
    drawn = [r.id for r in sampling.seeded_sample(rows, "id", n).collect()]
    assert len(drawn) == len(set(drawn)) == min(n, 50)
    assert set(drawn) <= {r.id for r in sampling.seeded_sample(rows, "id", n + 1).collect()}


@pytest.mark.parametrize("per_block", [64, 256, 1024, 4096])
def test_heads_are_cut_before_the_shuffle(spark, per_block):
    entries = spark.range(3000).withColumn("block", F.col("id") % 2)
    heads = blocking.heads(entries, ["block"], per_block)
    assert "WindowGroupLimit" in heads._jdf.queryExecution().executedPlan().toString()
    assert heads.count() == 2 * min(per_block, blocking.MAX_HEADS)


def test_failure_map_from_vectors(spark):
    rows = spark.createDataFrame(
        [(i, "A" if i < 6 else "B", "wrong [incomplete]", "right", 0.1 if i < 12 else 0.9)
         for i in range(20)],
        "sample_id long, clause_type string, prediction string, reference string, bertscore_f1 double",
    )
    vectors = spark.createDataFrame(
        [(i, [float(i < 5), float(i >= 5), 0.01 * i]) for i in range(20) if i != 11],
        "sample_id long, embedding array<double>",
    )
    points = {r.sample_id: r for r in failure_map(rows, vectors, 0.2).collect()}
    assert sorted(points) == list(range(12))
    assert [points[i].cluster_id for i in range(12)] == [0] * 5 + [5] * 6 + [-1]
    assert points[0].cluster_name == "A — Truncated responses (5 examples)"
    assert points[5].cluster_name == "B — Truncated responses (6 examples)"
    assert points[11].x is None and points[11].cluster_name == "Noise / Outliers"
    assert failure_map(rows.limit(2), vectors, 0.2).count() == 0
    few = failure_map(rows, vectors.limit(1), 0.2).collect()
    assert len(few) == 12 and {r.cluster_id for r in few} == {-1}


def test_bins_have_three_decimals_and_the_error_uses_exact_means(spark):
    rows = spark.createDataFrame(
        [("m", 0.31111, 1.0), ("m", 0.32222, 0.0), ("m", 0.33336, 0.0)],
        "model_tag string, confidence double, accurate double",
    )
    one = metrics.reliability_bins(rows).first()
    assert (one.accuracy, one.confidence) == (0.333, 0.322)
    assert metrics.calibration_error(rows).first().ece == round(abs(1 / 3 - 0.9666900 / 3), 4)


def test_unknown_models_and_missing_outputs(spark):
    table = spark.createDataFrame([("base", 0.5), ("new", 0.6)], "model_tag string, bertscore_f1 double")
    assert reports.model_comparison(table).count() == 1
    every = reports.model_comparison(table, tags=None)
    assert every.count() == 2
    best = reports.best_per_metric(every, tags=None).where("is_best AND metric = 'bertscore_f1'")
    assert [r.model_tag for r in best.collect()] == ["new"]
    outputs = spark.createDataFrame(
        [(1, "base", "a", 10), (1, "dpo", "b", 20), (2, "base", "c", 30)],
        "sample_id int, model_tag string, prediction string, latency_ms int",
    )
    shown = {r.sample_id: (r.base_output, r.finetuned_output, r.latency_base_ms, r.latency_finetuned_ms)
             for r in reports.side_by_side(outputs, "dpo").collect()}
    assert shown == {1: ("a", "b", 10, 20), 2: ("c", None, 30, None)}
