"""Evaluation metrics, failures, reports and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.curation import SPLIT_CTE, big, r4, split_rows
from checks.inputs import Tables, d, first, lit, n_words, strip, words
from checks.registry import query
from quillmill.functions import fixed
from quillmill.functions.draws import draw
from quillmill.operators import (
    clustering, failures, hierarchy, judge, layout, metrics, neighbours, reports, scoring,
)
from quillmill.plans.failures import failure_map
from quillmill.plans.evaluation import evaluate, result_documents
from quillmill.session import scratch_path
from quillmill.sources import io

TAG, ID = "model_tag", "sample_id"


# --- similarity and presence --------------------------------------------------------------


@query("align_predictions", """SELECT sample_id, model_tag, clause_type, prediction, reference
    FROM preds""")
def _(t: Tables):
    made = t.predictions.select(ID, TAG, "prediction")
    known = t.samples.select(ID, "clause_type", F.col("answer").alias("reference"))
    return metrics.align(made, known)


@query("prediction_rows", """SELECT model_tag, sample_id, substr(prompt, 1, 200) AS prompt,
    reference, prediction, clause_type, bertscore_f1 FROM preds""")
def _(t: Tables):
    return metrics.prediction_rows(t.predictions)


@query("similarity_summary", """SELECT model_tag, round(avg(precision), 4) AS bertscore_precision,
    round(avg(recall), 4) AS bertscore_recall, round(avg(f1), 4) AS bertscore_f1,
    round(stddev_samp(f1), 4) AS bertscore_f1_std FROM preds GROUP BY model_tag""")
def _(t: Tables):
    summary = metrics.similarity_summary(t.predictions)
    return summary.select(TAG, *[r4(c) for c in summary.columns if c != TAG])


REF_ABSENT = "(reference LIKE 'No %' OR contains(lower(reference), 'not found'))"
PRED_ABSENT = """(contains(lower(prediction), 'not found') OR contains(lower(prediction),
    'not present') OR contains(lower(prediction), 'no ' || lower(clause_type)))"""
PRESENCE = f"flags AS (SELECT *, {REF_ABSENT} AS ra, {PRED_ABSENT} AS pa FROM preds)"


@query("presence_flags", PRESENCE + """ == SELECT sample_id, model_tag, ra::BIGINT AS ref_absent,
    pa::BIGINT AS pred_absent FROM flags""")
def _(t: Tables):
    return metrics.with_presence(t.predictions).select(
        ID, TAG, big("ref_absent"), big("pred_absent")
    )


@query("presence_accuracy", PRESENCE + """ == SELECT model_tag, clause_type,
    grouping(clause_type)::BIGINT AS overall, count(*) AS rows,
    CASE WHEN grouping(clause_type) = 1 THEN round_even(avg((ra = pa)::INT), 4)
    ELSE round_even(avg((ra = pa)::INT), 3) END AS accuracy
    FROM flags GROUP BY GROUPING SETS ((model_tag), (model_tag, clause_type))""")
def _(t: Tables):
    return metrics.presence_accuracy(t.predictions)


# --- grounding ----------------------------------------------------------------------------

SENTENCES = f"""parts AS (SELECT sample_id, model_tag, contract_text, list_filter(list_transform(
        string_split(regexp_replace({strip("prediction")}, '([.!?])[\\s]+', '\\1' || chr(1), 'g'),
        chr(1)), lambda s: {strip("s")}), lambda s: len({words("s")}) > 3) AS ss FROM preds),
    sents AS (SELECT sample_id, model_tag, contract_text, unnest(range(len(ss))) AS sentence_no,
        unnest(ss) AS sentence FROM parts)"""


@query("sentence_split", SENTENCES + """ == SELECT sample_id, model_tag, sentence_no, sentence
    FROM sents""")
def _(t: Tables):
    return metrics.sentence_pairs(t.predictions).select(
        ID, TAG, big("sentence_no"), "sentence"
    )


PREMISE = first("contract_text", 512)


@query("sentence_pairs", SENTENCES + f""" == SELECT sample_id, model_tag, sentence_no,
    md5(substr({PREMISE}, 1, greatest(0, 1024 - length(' [SEP] ' || sentence))) || ' [SEP] ' ||
    sentence) AS pair_md5 FROM sents""")
def _(t: Tables):
    return metrics.sentence_pairs(t.predictions).select(
        ID, TAG, big("sentence_no"), F.md5("pair").alias("pair_md5")
    )


@query("sentence_pairs_legacy_cut", SENTENCES + f""" == SELECT sample_id, model_tag, sentence_no,
    md5(substr({PREMISE} || ' [SEP] ' || sentence, 1, 1024)) AS pair_md5 FROM sents""")
def _(t: Tables):
    return metrics.sentence_pairs(t.predictions, legacy_cut=True).select(
        ID, TAG, big("sentence_no"), F.md5("pair").alias("pair_md5")
    )


def judged(t: Tables):
    """Sentences with drawn scores in place of those of an external model."""
    pairs = metrics.sentence_pairs(t.predictions)
    keys = [F.col(TAG), F.col(ID), F.col("sentence_no")]

    def score(salt: str):
        return (draw(19, salt, *keys) % 11) / F.lit(10.0)

    scores = F.when(
        draw(19, "partial", *keys) % 5 == 0,
        F.create_map(F.lit("neutral"), score("neutral")),
    ).otherwise(
        F.create_map(
            F.lit("entailment"), score("entail"), F.lit("Contradiction"), score("contra")
        )
    )
    return pairs.select(ID, TAG, "sentence_no", metrics.verdict(scores).alias("verdict"))


_k = ("model_tag", "sample_id", "sentence_no")
VERDICTS = SENTENCES + f""",
    scored AS (SELECT *, CASE WHEN {d(19, "partial", *_k)} % 5 = 0 THEN 0
        ELSE ({d(19, "entail", *_k)} % 11) / 10.0::DOUBLE END AS e,
        CASE WHEN {d(19, "partial", *_k)} % 5 = 0 THEN 0
        ELSE ({d(19, "contra", *_k)} % 11) / 10.0::DOUBLE END AS k FROM sents),
    verdicts AS (SELECT sample_id, model_tag, sentence_no, CASE WHEN e >= 0.5 THEN 'grounded'
        WHEN k >= 0.5 THEN 'contradicted' ELSE 'ungrounded' END AS verdict FROM scored),
    rates AS (SELECT model_tag, count(*) AS total_sentences,
        round_even(count(*) FILTER (WHERE verdict <> 'grounded') / count(*), 4) AS hallucination_rate,
        round_even(count(*) FILTER (WHERE verdict = 'grounded') / count(*), 4) AS grounded_rate,
        round_even(count(*) FILTER (WHERE verdict = 'contradicted') / count(*), 4) AS contradiction_rate
        FROM verdicts GROUP BY model_tag)"""


@query("sentence_verdicts", VERDICTS + " == SELECT * FROM verdicts")
def _(t: Tables):
    return judged(t).select(ID, TAG, big("sentence_no"), "verdict")


@query("grounding_rates", VERDICTS + " == SELECT * FROM rates")
def _(t: Tables):
    return metrics.grounding_rates(judged(t), t.predictions)


# --- calibration --------------------------------------------------------------------------


def confidences(t: Tables):
    return t.predictions.select(
        TAG, ID, F.round(metrics.sequence_confidence(F.col("log_probs")), 6).alias("confidence"),
        metrics.is_accurate(F.col("f1")).alias("accurate"),
    )


_edges = ", ".join(repr(e) + "::DOUBLE" for e in metrics.bin_edges(10)[1:-1])
CALIBRATION = f"""conf AS (SELECT sample_id, model_tag, CASE WHEN len(log_probs) = 0 THEN 0.5
        ELSE round(least(1.0, greatest(0.0, exp(list_sum(log_probs) / len(log_probs)))), 6)
        END AS confidence, (f1 > 0.7)::INT::DOUBLE AS accurate FROM preds),
    binned AS (SELECT *, len(list_filter([{_edges}], lambda e: confidence >= e)) AS bin
        FROM conf WHERE confidence >= 0 AND confidence < 1.0),
    bins AS (SELECT model_tag, bin::BIGINT AS bin, count(*) AS count, avg(accurate) AS accuracy,
        avg(confidence) AS confidence FROM binned GROUP BY model_tag, bin),
    ece AS (SELECT model_tag, round(sum(count * abs(accuracy - confidence)) /
        (SELECT count(*) FROM conf c WHERE c.model_tag = bins.model_tag), 4) AS ece
        FROM bins GROUP BY model_tag)"""


@query("sequence_confidence", CALIBRATION + """ == SELECT sample_id, model_tag, confidence,
    accurate FROM conf""")
def _(t: Tables):
    return confidences(t)


@query("reliability_bins", CALIBRATION + """ == SELECT model_tag, bin, count,
    round(bin / 10, 2) AS bin_lower, round((bin + 1) / 10, 2) AS bin_upper,
    round_even(accuracy, 3) AS accuracy, round_even(confidence, 3) AS confidence FROM bins""")
def _(t: Tables):
    return metrics.reliability_bins(confidences(t)).select(
        TAG, big("bin"), "count", "bin_lower", "bin_upper", "accuracy", "confidence"
    )


@query("calibration_error", CALIBRATION + """ == SELECT ece.model_tag, ece,
    (SELECT count(*) FROM conf c WHERE c.model_tag = ece.model_tag) AS n_samples FROM ece""")
def _(t: Tables):
    return metrics.calibration_error(confidences(t))


@query("accuracy_proxy", """SELECT sample_id, model_tag, (f1 > 0.7)::INT::DOUBLE AS accurate
    FROM preds""")
def _(t: Tables):
    return t.predictions.select(ID, TAG, metrics.is_accurate(F.col("f1")).alias("accurate"))


@query("held_out_perplexity", """SELECT model_tag, round(avg(1 - f1), 4) AS eval_loss,
    round(exp(avg(1 - f1)), 4) AS eval_perplexity FROM preds GROUP BY model_tag""")
def _(t: Tables):
    losses = t.predictions.select(TAG, (1 - F.col("f1")).alias("loss"))
    return metrics.held_out_perplexity(losses, TAG).select(
        TAG, r4("eval_loss"), r4("eval_perplexity")
    )


# --- judge --------------------------------------------------------------------------------

JUDGED = """parts AS (SELECT sample_id, model_tag, regexp_extract(reply, '(?s)\\{.*\\}') AS j FROM replies),
    fields AS (SELECT sample_id, model_tag,
        coalesce(json_extract(j, '$.faithfulness'), '5') ->> '$' AS f,
        coalesce(json_extract(j, '$.completeness'), '5') ->> '$' AS c,
        coalesce(json_extract(j, '$.precision'), '5') ->> '$' AS p
        FROM parts WHERE j <> '' AND json_valid(j)),
    typed AS (SELECT sample_id, model_tag, try_cast(f AS DOUBLE) AS faithfulness,
        try_cast(c AS DOUBLE) AS c, try_cast(p AS DOUBLE) AS p FROM fields),
    scores AS (SELECT sample_id, model_tag, faithfulness, c AS completeness,
        CASE WHEN c IS NOT NULL THEN p END AS precision FROM typed WHERE faithfulness IS NOT NULL),
    judge AS (SELECT model_tag, round_even(avg(faithfulness) / 10, 3) AS geval_faithfulness,
        round_even(avg(completeness) / 10, 3) AS geval_completeness,
        round_even(avg(precision) / 10, 3) AS geval_precision, count(*) AS geval_samples
        FROM scores GROUP BY model_tag)"""


@query("judge_parse", JUDGED + " == SELECT * FROM scores")
def _(t: Tables):
    return judge.parse_scores(t.replies.select(ID, TAG, "reply")).drop("reply")


@query("judge_summary", JUDGED + " == SELECT * FROM judge")
def _(t: Tables):
    return judge.judge_summary(judge.parse_scores(t.replies))


def _side(side: str, prefix: str) -> str:
    return ", ".join(
        f"coalesce(try_cast(json_extract_string(j, '$.{side}.{n}') AS DOUBLE), 0) AS {prefix}_{n}"
        for n in fixed.JUDGE_DIMENSIONS
    )


@query("judge_pair_parse", f"""parts AS (SELECT sample_id, model_tag,
        regexp_extract(pair_reply, '(?s)\\{{.*\\}}') AS j FROM replies),
    sides AS (SELECT sample_id, model_tag, {_side("A", "base")}, {_side("B", "tuned")}
        FROM parts WHERE j <> '' AND json_valid(j))
    == SELECT *, round((base_faithfulness + base_completeness + base_precision) / 3, 4) AS base_mean,
    round((tuned_faithfulness + tuned_completeness + tuned_precision) / 3, 4) AS tuned_mean
    FROM sides""")
def _(t: Tables):
    parsed = judge.parse_pair_scores(t.replies.select(ID, TAG, "pair_reply"), "pair_reply")
    return parsed.drop("pair_reply").withColumns(
        {c: F.round(c, 4) for c in ("base_mean", "tuned_mean")}
    )


# --- one row per model --------------------------------------------------------------------


def evaluation(t: Tables):
    t.predictions = t.stored_predictions
    return evaluate(t.predictions, judged(t), confidences(t), judge.parse_scores(t.replies))


METRICS = "\n".join([
    VERDICTS + ",",
    CALIBRATION + ",",
    JUDGED.replace("parts AS", "reply_parts AS").replace("FROM parts", "FROM reply_parts") + ",",
    PRESENCE + ",",
    """table_rows AS (SELECT p.model_tag, count(*) AS n_test,
        round(avg(precision), 4) AS bertscore_precision, round(avg(recall), 4) AS bertscore_recall,
        round(avg(f1), 4) AS bertscore_f1, round(stddev_samp(f1), 4) AS bertscore_f1_std,
        (SELECT round_even(avg((ra = pa)::INT), 4) FROM flags f WHERE f.model_tag = p.model_tag)
        AS clause_presence_accuracy FROM preds p GROUP BY p.model_tag),
    metrics AS (SELECT * FROM table_rows JOIN rates USING (model_tag) JOIN ece USING (model_tag)
        JOIN judge USING (model_tag))""",
])


def _rounded(df):
    names = [
        "bertscore_precision", "bertscore_recall", "bertscore_f1", "bertscore_f1_std",
    ]
    return df.withColumns({n: F.round(n, 4) for n in names})


@query("evaluate_models", METRICS + " == SELECT * FROM metrics")
def _(t: Tables):
    return _rounded(evaluation(t))


def stored_results(t: Tables):
    """The result documents, written as JSON and read again."""
    documents = result_documents(_rounded(evaluation(t)), t.predictions, confidences(t))
    path = scratch_path(t.spark, "results")
    io.write_documents(documents, path)
    return io.read_documents(t.spark, path, documents.schema)


@query("result_bins", METRICS + """ == SELECT model_tag, n_test, ece, round(bin / 10, 2) AS bin_lower,
    round((bin + 1) / 10, 2) AS bin_upper, round_even(accuracy, 3) AS accuracy,
    round_even(confidence, 3) AS confidence, count FROM metrics JOIN bins USING (model_tag)""")
def _(t: Tables):
    return stored_results(t).select(TAG, "n_test", "ece", F.explode("bin_stats").alias("b")).select(
        TAG, "n_test", "ece", "b.*")


@query("result_classes", METRICS + """ == SELECT model_tag, hallucination_rate, clause_type,
    round_even(avg((ra = pa)::INT), 3) AS accuracy FROM flags JOIN metrics USING (model_tag)
    GROUP BY ALL""")
def _(t: Tables):
    return stored_results(t).select(
        TAG, "hallucination_rate",
        F.explode("clause_accuracy_by_type").alias("clause_type", "accuracy"))


_metric_names = [
    "n_test", "bertscore_precision", "bertscore_recall", "bertscore_f1", "bertscore_f1_std",
    "clause_presence_accuracy", "hallucination_rate", "grounded_rate", "contradiction_rate",
    "total_sentences", "ece", "geval_faithfulness", "geval_completeness", "geval_precision",
    "geval_samples",
]


@query("metric_log", METRICS + " == " + " UNION ALL ".join(
    f"SELECT model_tag, '{n}' AS metric, {n}::DOUBLE AS value FROM metrics WHERE {n} IS NOT NULL"
    for n in _metric_names
))
def _(t: Tables):
    return io.metric_rows(_rounded(evaluation(t)), TAG)


# --- failures -----------------------------------------------------------------------------


@query("failure_filter", """SELECT sample_id, model_tag, bertscore_f1 FROM preds
    WHERE coalesce(bertscore_f1, 1.0) < 0.65""")
def _(t: Tables):
    return failures.select_failures(t.predictions.select(ID, TAG, "bertscore_f1"))


CLUSTERS = f"""stats AS (SELECT cluster_id, count(*) AS members,
        count(*) FILTER (WHERE contains(prediction, '[incomplete]')) AS truncated,
        count(*) FILTER (WHERE contains(lower(prediction), 'not found')
            AND NOT contains(lower(reference), 'not found')) AS absent_error,
        count(*) FILTER (WHERE {n_words("prediction")} > 2 * {n_words("reference")} + 10) AS too_long
        FROM clustered GROUP BY cluster_id),
    per_class AS (SELECT cluster_id, clause_type, count(*) AS n, min(sample_id) AS f
        FROM clustered GROUP BY cluster_id, clause_type),
    tops AS (SELECT cluster_id, clause_type AS top_class FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster_id ORDER BY n DESC, f) AS rn FROM per_class) WHERE rn = 1),
    decided AS (SELECT *, CASE WHEN truncated > members * 0.4::DOUBLE THEN 'Truncated responses'
        WHEN absent_error > members * 0.3::DOUBLE THEN 'False negatives (clause present, not found)'
        WHEN too_long > members * 0.3::DOUBLE THEN 'Over-generation / hallucination'
        ELSE 'Semantic mismatch' END AS pattern FROM stats JOIN tops USING (cluster_id)),
    labelled AS (SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'Noise / Outliers' ELSE
        top_class || ' — ' || pattern || ' (' || members || ' examples)' END AS cluster_name
        FROM decided),
    points AS (SELECT sample_id, clause_type, cluster_id, coalesce(cluster_name, 'Cluster ' ||
        cluster_id) AS cluster_name, x, y, substr(prediction, 1, 300) AS prediction,
        substr(reference, 1, 300) AS reference FROM clustered LEFT JOIN labelled
        USING (cluster_id) WHERE (SELECT count(*) FROM clustered) >= 3)"""


@query("cluster_majority", CLUSTERS + " == SELECT * FROM tops")
def _(t: Tables):
    return failures.majority_class(t.clustered)


@query("cluster_patterns", CLUSTERS + " == SELECT * FROM stats")
def _(t: Tables):
    return failures.cluster_patterns(t.clustered)


@query("cluster_decision", CLUSTERS + " == SELECT cluster_id, pattern FROM decided")
def _(t: Tables):
    stats = failures.cluster_patterns(t.clustered)
    return stats.select("cluster_id", failures.decide_pattern().alias("pattern"))


@query("cluster_labels", CLUSTERS + " == SELECT * FROM labelled")
def _(t: Tables):
    return failures.label_clusters(t.clustered)


def points(t: Tables):
    return failures.failure_points(t.clustered, failures.label_clusters(t.clustered))


@query("failure_map", CLUSTERS + """ == SELECT * REPLACE (round(x, 4) AS x, round(y, 4) AS y)
    FROM points""")
def _(t: Tables):
    return points(t).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query("failure_summary", CLUSTERS + """ == SELECT count(*) AS n_failures,
    count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS n_clusters FROM points""")
def _(t: Tables):
    return failures.failure_summary(points(t))


@query("failure_map_scaled", """limits AS (SELECT min(x) AS x0, max(x) - min(x) AS sx,
    min(y) AS y0, max(y) - min(y) AS sy FROM clustered)
    == SELECT sample_id, round(34 + (x - x0) / CASE WHEN sx = 0 THEN 1 ELSE sx END * 692, 4) AS px,
    round(426 - (y - y0) / CASE WHEN sy = 0 THEN 1 ELSE sy END * 392, 4) AS py
    FROM clustered, limits""")
def _(t: Tables):
    return failures.scale_map(t.clustered).select(ID, r4("px"), r4("py"))


@query("failure_drill_down", CLUSTERS + """ == SELECT sample_id, cluster_name, prediction
    FROM points WHERE cluster_id = 2""")
def _(t: Tables):
    return failures.failures_of(points(t), 2).select(ID, "cluster_name", "prediction")


# --- embeddings ---------------------------------------------------------------------------


POWER = """{name}(step, v) AS (
        SELECT 0, list_transform(c[1], lambda x, i: (i % 7 + 1)::DOUBLE) FROM {matrix}
        UNION ALL
        SELECT step + 1, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw)))
        FROM (SELECT step, list_transform(c, lambda row: list_dot_product(row, v)) AS raw
            FROM {name}, {matrix} WHERE step < 3000)),
    {name}_axis AS MATERIALIZED (SELECT list_transform(v, lambda x: x * CASE
            WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v,
        list_dot_product(list_transform(c, lambda row: list_dot_product(row, v)), v) AS length
        FROM {name}, {matrix} WHERE step = 3000)"""


@query("project_2d", """flat AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x,
        generate_subscripts(embedding, 1) AS k FROM embeddings),
    means AS (SELECT k, avg(x) AS m FROM flat GROUP BY k),
    moved AS MATERIALIZED (SELECT vec_id, k, x - m AS x FROM flat JOIN means USING (k)),
    cells AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS s FROM moved a JOIN moved b
        ON a.vec_id = b.vec_id GROUP BY a.k, b.k),
    lines AS (SELECT i, list(s ORDER BY j) AS row FROM cells GROUP BY i),
    one AS MATERIALIZED (SELECT list(row ORDER BY i) AS c FROM lines),
    """ + POWER.format(name="first_power", matrix="one") + """,
    two AS MATERIALIZED (SELECT list_transform(c, lambda row, i: list_transform(row, lambda x, j:
        x - length * v[i] * v[j])) AS c FROM one, first_power_axis),
    """ + POWER.format(name="second_power", matrix="two") + """,
    vectors AS (SELECT vec_id, list(x ORDER BY k) AS e FROM moved GROUP BY vec_id),
    shift AS (SELECT list(m ORDER BY k) AS m FROM means)
    == SELECT vec_id, round(list_dot_product(e, a.v), 4) AS x, round(list_dot_product(e, b.v), 4) AS y
    FROM vectors, first_power_axis a, second_power_axis b""")
def _(t: Tables):
    return clustering.project_2d(t.table("embeddings"), "vec_id", "embedding").select(
        "vec_id", r4("x"), r4("y")
    )


@query("kmeans_clusters")
def _(t: Tables):
    return clustering.kmeans_clusters(t.table("embeddings"), "vec_id", "embedding")


def density_sql(min_size: str) -> str:
    return f"""near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a, embeddings b
        WHERE a.vec_id <> b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.1),
    reach AS (SELECT vec_id AS i, vec_id AS root FROM embeddings UNION
        SELECT n.j, r.root FROM reach r JOIN near n ON n.i = r.i),
    comps AS (SELECT i AS vec_id, min(root) AS root FROM reach GROUP BY i),
    sized AS (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM comps)
    == SELECT vec_id, CASE WHEN n >= {min_size} THEN root ELSE -1 END AS cluster_id FROM sized"""


@query("density_clusters", density_sql("greatest(4, (SELECT count(*) FROM embeddings) // 20)"))
def _(t: Tables):
    return clustering.density_clusters(t.table("embeddings"), "vec_id", "embedding", 1.1)


@query("density_clusters_small", density_sql("2"))
def _(t: Tables):
    return clustering.density_clusters(
        t.table("embeddings"), "vec_id", "embedding", 1.1, min_size=2
    )


@query("neighbour_lists", """pairs AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbour,
        list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour)::INTEGER
        AS place FROM pairs)
    == SELECT vec_id, place, neighbour, round(d, 6) AS distance FROM numbered WHERE place <= 15""")
def _(t: Tables):
    points = t.table("embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    lists = neighbours.neighbour_lists(points)
    return lists.select(F.col("id").alias("vec_id"), F.posexplode("list").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).alias("place"), F.col("x.n").alias("neighbour"),
        F.round("x.d", 6).alias("distance"))


@query("fuzzy_edges", """unit AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    pairs AS (SELECT a.vec_id AS i, b.vec_id AS j,
        1 - list_cosine_similarity(a.e, b.e) AS d FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
    near AS MATERIALIZED (SELECT i, j, d - min(d) OVER (PARTITION BY i) AS gap FROM pairs
        QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 15),
    gaps AS MATERIALIZED (SELECT i, list(gap) AS gs FROM near GROUP BY i),
    bisected(step, i, gs, low, high, sigma) AS (
        SELECT 0, i, gs, 0.0::DOUBLE, 1e300::DOUBLE, 1.0::DOUBLE FROM gaps
        UNION ALL
        SELECT step + 1, i, gs, CASE WHEN over THEN low ELSE sigma END,
            CASE WHEN over THEN sigma ELSE high END,
            CASE WHEN over THEN (low + sigma) / 2 WHEN high = 1e300 THEN sigma * 2
                ELSE (sigma + high) / 2 END
        FROM (SELECT *, list_sum(list_transform(gs, lambda g: exp(-g / sigma))) > log2(len(gs)) AS over
            FROM bisected WHERE step < 64)),
    given AS (SELECT n.i, n.j, exp(-gap / sigma) AS w FROM near n JOIN bisected b
        ON n.i = b.i AND b.step = 64),
    joint AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(w) AS u,
        CASE WHEN count(*) > 1 THEN min(w) ELSE 0 END AS v FROM given GROUP BY ALL)
    == SELECT a, b, round(u + v - u * v, 4) AS weight FROM joint WHERE u + v - u * v > 0""")
def _(t: Tables):
    raw = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda total, x: total + x * x))
    points = t.table("embeddings").select(
        F.col("vec_id").alias("id"), F.transform(raw, lambda x: x / norm).alias("vector"),
        raw.alias("raw"), norm.alias("norm"))
    angles = neighbours.neighbour_lists(points).select("id", F.transform("list", lambda x: F.struct(
        (x["d"] * x["d"] / 2).alias("d"), x["n"].alias("n"))).alias("list"))
    return layout.fuzzy_edges(angles).select("a", "b", F.round("weight", 4).alias("weight"))


@query("neighbour_layout")
def _(t: Tables):
    return layout.neighbour_layout(t.table("embeddings"), "vec_id", "embedding").select(
        "vec_id", r4("x"), r4("y"))


@query("spanning_tree", """v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
        row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
    rows_of AS MATERIALIZED (SELECT a.i, list(list_distance(a.e, b.e) ORDER BY b.i) AS ds
        FROM v a, v b GROUP BY a.i),
    grown(step, best, w) AS (
        SELECT 1, list_transform(ds, lambda x, i: CASE WHEN i = 1 THEN 1e300 ELSE x END), NULL::DOUBLE
        FROM rows_of WHERE i = 1
        UNION ALL
        SELECT step + 1, list_transform(g.best, lambda x, i: CASE WHEN x = 1e300
                OR i = list_position(g.best, list_min(g.best)) THEN 1e300 ELSE least(x, ds[i]) END),
            list_min(g.best)
        FROM grown g JOIN rows_of r ON r.i = list_position(g.best, list_min(g.best))
        WHERE list_min(g.best) < 1e300)
    == SELECT (row_number() OVER (ORDER BY w) - 1)::BIGINT AS rank, round(w, 6) AS w
    FROM grown WHERE w IS NOT NULL""")
def _(t: Tables):
    points = t.table("embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return hierarchy.ranked(hierarchy.spanning_tree(points)).select("rank", F.round("w", 6).alias("w"))


@query("hierarchical_clusters")
def _(t: Tables):
    return hierarchy.hierarchical_clusters(t.table("embeddings"), "vec_id", "embedding")


CHAIN = """failed AS MATERIALIZED (SELECT sample_id, clause_type, prediction, reference,
        embedding::DOUBLE[] AS v FROM preds LEFT JOIN embeddings ON vec_id = sample_id
        WHERE model_tag = 'dpo' AND coalesce(bertscore_f1, 1) < 0.65),
    near AS MATERIALIZED (SELECT a.sample_id AS i, b.sample_id AS j FROM failed a, failed b
        WHERE a.sample_id <> b.sample_id AND a.v IS NOT NULL AND b.v IS NOT NULL
            AND list_distance(a.v, b.v) <= 1.1),
    reach AS (SELECT sample_id AS i, sample_id AS root FROM failed WHERE v IS NOT NULL UNION
        SELECT n.j, r.root FROM reach r JOIN near n ON n.i = r.i),
    comps AS (SELECT i AS sample_id, min(root) AS root FROM reach GROUP BY i),
    sized AS (SELECT *, count(*) OVER (PARTITION BY root) AS n, count(*) OVER () AS total FROM comps),
    chained AS MATERIALIZED (SELECT sample_id, clause_type, prediction, reference, 0 AS x, 0 AS y,
        CASE WHEN n >= greatest(4, total // 20) THEN root ELSE -1 END AS cluster_id
        FROM failed LEFT JOIN sized USING (sample_id)),
    """ + CLUSTERS.replace("clustered", "chained")


@query("failure_chain", CHAIN + """ == SELECT sample_id, clause_type, cluster_id, cluster_name,
    prediction, reference FROM points""")
def _(t: Tables):
    vectors = t.table("embeddings").select(F.col("vec_id").alias(ID), "embedding")
    rows = t.predictions.where(F.col(TAG) == "dpo")
    return failure_map(rows, vectors, 1.1).drop("x", "y")


# --- reports ------------------------------------------------------------------------------

LENGTHS = f"""lens AS (SELECT {n_words("answer")} AS a, source_length AS c FROM samples)"""


@query("card_counts", SPLIT_CTE + """== SELECT count(*) FILTER (WHERE split = 'train') AS train,
    count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test,
    count(*) AS total FROM split_rows""")
def _(t: Tables):
    return reports.card_counts(split_rows(t))


@query("card_lengths", LENGTHS + """ == SELECT round_even(avg(a), 1) AS answer_mean,
    round_even(quantile_cont(a, 0.5), 1) AS answer_median,
    round_even(quantile_cont(a, 0.95), 1) AS answer_p95,
    round_even(avg(c), 1) AS context_mean, round_even(quantile_cont(c, 0.5), 1) AS context_median
    FROM lens""")
def _(t: Tables):
    return reports.card_lengths(t.samples)


@query("dataset_card", SPLIT_CTE + "," + LENGTHS + """ == SELECT
    count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'test') AS test,
    (SELECT string_agg(clause_type || '=' || n, ';' ORDER BY clause_type) FROM (
        SELECT clause_type, count(*) AS n FROM samples GROUP BY clause_type)) AS classes,
    (SELECT round_even(quantile_cont(a, 0.95), 1) FROM lens) AS p95,
    (SELECT round_even(avg(c), 1) FROM lens) AS context_mean FROM split_rows""")
def _(t: Tables):
    card = reports.dataset_card(split_rows(t), "documents")
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return card.select(
        "splits.train", "splits.test",
        F.array_join(F.transform(F.map_entries("clause_distribution"), entry), ";")
        .alias("classes"),
        F.col("answer_length_stats.p95").alias("p95"),
        F.col("context_length_stats.mean").alias("context_mean"),
    )


@query("card_document", SPLIT_CTE + "," + LENGTHS + """ == SELECT 'documents' AS dataset,
    count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
    count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total,
    (SELECT string_agg(clause_type || '=' || n, ';' ORDER BY clause_type) FROM (
        SELECT clause_type, count(*) AS n FROM samples GROUP BY clause_type)) AS classes,
    (SELECT round_even(avg(a), 1) FROM lens) AS answer_mean,
    (SELECT round_even(quantile_cont(a, 0.5), 1) FROM lens) AS answer_median,
    (SELECT round_even(quantile_cont(a, 0.95), 1) FROM lens) AS answer_p95,
    (SELECT round_even(avg(c), 1) FROM lens) AS context_mean,
    (SELECT round_even(quantile_cont(c, 0.5), 1) FROM lens) AS context_median FROM split_rows""")
def _(t: Tables):
    card, path = reports.dataset_card(split_rows(t), "documents"), scratch_path(t.spark, "card")
    io.write_documents(card, path)
    read = io.read_documents(t.spark, path, card.schema)
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return read.select(
        "dataset", "splits.*",
        F.array_join(F.transform(F.array_sort(F.map_entries("clause_distribution")), entry), ";")
        .alias("classes"),
        *[F.col(f"answer_length_stats.{x}").alias(f"answer_{x}") for x in ("mean", "median", "p95")],
        *[F.col(f"context_length_stats.{x}").alias(f"context_{x}") for x in ("mean", "median")],
    )


@query("class_distribution", """counts AS (SELECT clause_type, count(*) AS count FROM samples
    GROUP BY clause_type) == SELECT clause_type, count,
    round(100 * count / (SELECT sum(count) FROM counts), 4) AS percent,
    round(count / (SELECT max(count) FROM counts), 4) AS share_of_max FROM counts""")
def _(t: Tables):
    return reports.class_distribution(t.samples).select(
        "clause_type", "count", r4("percent"), r4("share_of_max")
    )


COMPARISON = METRICS + """,
    memory AS (SELECT * FROM (VALUES ('base', 6.8::DOUBLE), ('lora', 7.2::DOUBLE),
        ('qlora', 3.9::DOUBLE), ('dpo', 4.1::DOUBLE)) v(model_tag, vram_gb)),
    comparison AS (SELECT model_tag, geval_faithfulness, bertscore_f1, clause_presence_accuracy,
        hallucination_rate, ece, coalesce(vram_gb, 0.0::DOUBLE) AS vram_gb
        FROM metrics LEFT JOIN memory USING (model_tag)),
    long AS (UNPIVOT (SELECT model_tag, bertscore_f1::DOUBLE AS bertscore_f1,
        clause_presence_accuracy::DOUBLE AS clause_presence_accuracy,
        hallucination_rate::DOUBLE AS hallucination_rate, ece::DOUBLE AS ece FROM comparison)
        ON bertscore_f1, clause_presence_accuracy, hallucination_rate, ece
        INTO NAME metric VALUE value)"""


def comparison(t: Tables):
    return reports.model_comparison(_rounded(evaluation(t)))


@query("model_comparison", COMPARISON + " == SELECT * FROM comparison")
def _(t: Tables):
    return comparison(t)


@query("best_per_metric", COMPARISON + """ == SELECT model_tag, metric, value,
    round(value / max(value) OVER (PARTITION BY metric), 4) AS share_of_max,
    (value = CASE WHEN metric IN ('hallucination_rate', 'ece') THEN min(value) OVER (PARTITION BY
    metric) ELSE max(value) OVER (PARTITION BY metric) END)::BIGINT AS is_best FROM long""")
def _(t: Tables):
    return reports.best_per_metric(comparison(t)).select(
        TAG, "metric", "value", r4("share_of_max"), big("is_best")
    )


@query("change_from_base", COMPARISON + """ == SELECT b.metric, b.value AS base,
    'dpo' AS tuned_tag, t.value AS tuned, round(t.value - b.value, 4) AS change
    FROM long b JOIN long t ON b.metric = t.metric AND t.model_tag = 'dpo'
    WHERE b.model_tag = 'base'""")
def _(t: Tables):
    return reports.change_from_base(comparison(t)).select(
        "metric", "base", "tuned_tag", "tuned", r4("change")
    )


@query("side_by_side", """SELECT b.sample_id, b.prediction AS base_output,
    t.prediction AS finetuned_output, b.latency_ms AS latency_base_ms,
    t.latency_ms AS latency_finetuned_ms FROM preds b JOIN preds t USING (sample_id)
    WHERE b.model_tag = 'base' AND t.model_tag = 'dpo'""")
def _(t: Tables):
    return reports.side_by_side(t.predictions, "dpo")


# --- external scorers ---------------------------------------------------------------------


@query("score_pairs", f"""pt AS (SELECT sample_id, model_tag, w, count(*) AS n FROM (SELECT
        sample_id, model_tag, unnest({words("lower(prediction)")}) AS w FROM preds) GROUP BY ALL),
    rt AS (SELECT sample_id, model_tag, w, count(*) AS n FROM (SELECT
        sample_id, model_tag, unnest({words("lower(reference)")}) AS w FROM preds) GROUP BY ALL),
    hits AS (SELECT sample_id, model_tag, sum(least(pt.n, rt.n)) AS c FROM pt
        JOIN rt USING (sample_id, model_tag, w) GROUP BY ALL),
    sums AS (SELECT sample_id, model_tag, coalesce(c, 0)::DOUBLE AS c, {n_words("prediction")} AS p,
        {n_words("reference")} AS r FROM preds LEFT JOIN hits USING (sample_id, model_tag))
    == SELECT sample_id, model_tag, round(CASE WHEN p > 0 THEN c / p ELSE 0 END, 4) AS precision,
    round(CASE WHEN r > 0 THEN c / r ELSE 0 END, 4) AS recall,
    round(CASE WHEN c > 0 THEN 2 * (c / p) * (c / r) / (c / p + c / r) ELSE 0 END, 4) AS f1
    FROM sums""")
def _(t: Tables):
    scored = scoring.score_pairs(
        t.predictions, scoring.load_token_f1, [ID, TAG], "prediction", "reference",
        "precision DOUBLE, recall DOUBLE, f1 DOUBLE", batch_rows=64,
    )
    return scored.select(ID, TAG, r4("precision"), r4("recall"), r4("f1"))
