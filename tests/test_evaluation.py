"""Rules of evaluation, failures and reports on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import sentences
from quillmill.operators import failures, judge, metrics, prompts, reports, scoring
from quillmill.sources import io
from quillmill.session import scratch_path


def test_presence_rules_are_not_symmetric(spark):
    df = spark.createDataFrame([
        (0, "No clause found.", "No clause found."),
        (1, "No clause found.", "No Governing Law clause found."),
        (2, "text", "It was Not Found."),
        (3, "text", "not present"),
        (4, "text", ""),
    ], "id int, reference string, prediction string").withColumn(
        "clause_type", F.lit("Governing Law"))
    got = [(r.ref_absent, r.pred_absent)
           for r in metrics.with_presence(df).orderBy("id").collect()]
    assert got == [(True, False), (True, True), (False, True), (False, True), (False, False)]


def test_sentences_split_after_marks_and_need_four_words(spark):
    text = "A b c d. E f!  G h i j?\nK l m n"
    df = spark.createDataFrame([(text,), ("",), ("one two three.",)], "t string")
    got = [r[0] for r in df.select(sentences(F.col("t"))).collect()]
    assert got == [["A b c d.", "G h i j?", "K l m n"], [], []]


def test_sentence_stays_whole_unless_the_legacy_cut_is_asked_for(spark):
    df = spark.createDataFrame(
        [(1, "base", " ".join(["word"] * 600), "This is one sentence.")],
        "sample_id int, model_tag string, contract_text string, prediction string")
    pair = metrics.sentence_pairs(df).first().pair
    assert len(pair) == 1024 and pair.endswith(" [SEP] This is one sentence.")
    legacy = metrics.sentence_pairs(df, legacy_cut=True).first().pair
    assert len(legacy) == 1024 and "[SEP]" not in legacy


@pytest.mark.parametrize("scores, verdict", [
    ({"entailment": 0.5, "contradiction": 0.5}, "grounded"),
    ({"ENTAILMENT": 0.4, "Contradiction": 0.5}, "contradicted"),
    ({"entailment": 0.4, "contradiction": 0.4}, "ungrounded"),
    ({"neutral": 1.0}, "ungrounded"),
])
def test_verdicts(spark, scores, verdict):
    df = spark.createDataFrame([(scores,)], "s map<string,double>")
    assert df.select(metrics.verdict(F.col("s"))).first()[0] == verdict


def test_grounding_of_a_model_without_sentences_is_zero(spark):
    judged = spark.createDataFrame([("base", "grounded")], "model_tag string, verdict string")
    models = spark.createDataFrame([("base",), ("dpo",)], "model_tag string")
    got = {r.model_tag: tuple(r)[1:] for r in metrics.grounding_rates(judged, models).collect()}
    assert got == {"base": (0.0, 1.0, 0.0, 1), "dpo": (0.0, 0.0, 0.0, 0)}


def test_confidence_bins(spark):
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(metrics.bin_index(F.col("c"), 10)).collect()]
    assert got == [0, 1, 2, 5, 6, 9, None]
    closed = df.select(metrics.bin_index(F.col("c"), 10, close_last=True)).collect()
    assert closed[-1][0] == 9


def test_error_counts_rows_outside_the_bins(spark):
    df = spark.createDataFrame(
        [("m", 0.25, 1.0), ("m", 1.0, 1.0)], "model_tag string, confidence double, accurate double")
    row = metrics.calibration_error(df).first()
    assert (row.ece, row.n_samples) == (0.375, 2)


def test_confidence_of_sequences(spark):
    df = spark.createDataFrame([([-1.0, -3.0],), ([],), ([2.0],)], "l array<double>")
    got = [r[0] for r in df.select(metrics.sequence_confidence(F.col("l"))).collect()]
    assert got == [pytest.approx(0.1353352832), 0.5, 1.0]


def test_judge_replies(spark):
    replies = [
        '{"faithfulness": 1, "completeness": 2, "precision": 3}',
        'Sure:\n{"faithfulness": 1.5,\n"precision": 3} done',
        '{"faithfulness": "7", "completeness": "high", "precision": 9}',
        '{"faithfulness": null}', "no scores", '{"faithfulness": 1,}',
        '{"faithfulness": 1} or {"faithfulness": 2}', "{'faithfulness': 1}",
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [tuple(r)[2:] for r in judge.parse_scores(df).orderBy("i").collect()]
    assert got == [(1.0, 2.0, 3.0), (1.5, 5.0, 3.0), (7.0, None, None)]


def test_pair_replies(spark):
    df = spark.createDataFrame(
        [('x {"A": {"faithfulness": 9, "completeness": "6"}, "C": 1}',), ("none",)], "reply string")
    (row,) = judge.parse_pair_scores(df).collect()
    assert (row.base_faithfulness, row.base_completeness, row.base_precision) == (9.0, 6.0, 0.0)
    assert row.base_mean == 5.0 and row.tuned_mean == 0.0


def test_judge_prompt_shows_empty_outputs(spark):
    made = prompts.pair_judge_prompt(F.lit("c" * 2000), F.lit("Audit Rights"), F.lit(""), F.lit("b"))
    text = spark.range(1).select(made).first()[0]
    assert "Output A:\n(empty)\n" in text and "c" * 1500 + "\n" in text and "c" * 1501 not in text


def test_missing_score_is_no_failure_and_preview_is_a_fallback(spark):
    rows = spark.createDataFrame([(0, 0.64), (1, 0.65), (2, None)], "id int, bertscore_f1 double")
    assert [r.id for r in failures.select_failures(rows).collect()] == [0]
    preview = spark.createDataFrame([(9, 0.1)], rows.schema)
    assert [r.id for r in failures.select_failures(rows, preview).collect()] == [0]
    assert [r.id for r in failures.select_failures(rows.limit(0), preview).collect()] == [9]


def clustered(spark, rows):
    return spark.createDataFrame(
        rows, "sample_id bigint, cluster_id bigint, clause_type string, prediction string, "
        "reference string").withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})


def test_cluster_labels(spark):
    cut, gone = "a [incomplete]", "Not found"
    rows = [(i, 0, c, cut if i < 2 else "p", "r") for i, c in enumerate("BABAC")]  # 40 %
    rows += [(10 + i, 1, "A", gone if i < 4 else "p", "r") for i in range(10)]  # 40 % absent
    rows += [(30 + i, 2, None, "w " * 13 if i < 3 else "p", "r") for i in range(10)]  # 30 %
    rows += [(50, -1, "A", cut, "r")]
    frame = clustered(spark, rows)
    got = {r.cluster_id: r.cluster_name for r in failures.label_clusters(frame).collect()}
    assert got == {
        0: "B — Semantic mismatch (5 examples)",
        1: "A — False negatives (clause present, not found) (10 examples)",
        2: "Unknown — Semantic mismatch (10 examples)",
        -1: fixed.NOISE_LABEL,
    }
    points = failures.failure_points(frame, failures.label_clusters(frame))
    assert tuple(failures.failure_summary(points).first()) == (26, 3)
    assert failures.scale_map(points).select("px", "py").distinct().collect() == [(34.0, 426.0)]


def test_two_failures_give_an_empty_map(spark):
    frame = clustered(spark, [(i, 0, "A", "p", "r") for i in range(2)])
    assert failures.failure_points(frame, failures.label_clusters(frame)).count() == 0


def test_model_tables(spark):
    table = spark.createDataFrame(
        [("base", 0.5, None, 0.9, 0.4, 0.3), ("qlora", 0.5, 0.7, None, 0.2, 0.3),
         ("other", 1.0, 1.0, 1.0, 0.0, 0.0)],
        "model_tag string, bertscore_f1 double, geval_faithfulness double, "
        "clause_presence_accuracy double, hallucination_rate double, ece double")
    shown = reports.model_comparison(table)
    rows = {r.model_tag: r for r in shown.collect()}
    assert set(rows) == {"base", "qlora"} and rows["qlora"].clause_presence_accuracy == 0.0
    assert rows["base"].geval_faithfulness is None and rows["base"].vram_gb == 6.8
    best = {(r.model_tag, r.metric) for r in reports.best_per_metric(shown).collect() if r.is_best}
    assert best == {
        ("base", "bertscore_f1"), ("qlora", "bertscore_f1"), ("base", "clause_presence_accuracy"),
        ("qlora", "hallucination_rate"), ("base", "ece"), ("qlora", "ece"),
    }
    change = {r.metric: r for r in reports.change_from_base(shown).collect()}
    assert change["hallucination_rate"].tuned_tag == "qlora"
    assert change["hallucination_rate"].change == pytest.approx(-0.2)


def test_metric_rows_and_append(spark):
    table = spark.createDataFrame(
        [("base", 1, None, "x"), ("dpo", 2, 0.5, "y")], "model_tag string, n int, e double, s string")
    path = scratch_path(spark, "metrics")
    io.append_metrics(table, "model_tag", path)
    io.append_metrics(table.where("n = 2"), "model_tag", path)
    got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert got == [("base", "n", 1.0), *[("dpo", "e", 0.5)] * 2, *[("dpo", "n", 2.0)] * 2]


def test_scorer_sees_missing_text_as_empty(spark):
    df = spark.createDataFrame([(1, "a b", "a c"), (2, None, "x")], "id int, p string, r string")
    got = scoring.score_pairs(
        df, scoring.load_token_f1, ["id"], "p", "r", "precision double, recall double, f1 double")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0.5, 0.5, 0.5), (2, 0.0, 0.0, 0.0)]
