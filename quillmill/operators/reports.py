"""Dataset card and model comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import n_words
from quillmill.operators.metrics import TAG
from quillmill.operators.scale import exact_percentiles
from quillmill.session import materialize
from quillmill.sources.io import SPLITS

COMPARED = ["bertscore_f1", "clause_presence_accuracy", "hallucination_rate", "ece"]


def card_counts(samples: DataFrame) -> DataFrame:
    """One row: rows per split and in total."""
    return samples.agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS],
        F.count(F.lit(1)).alias("total"),
    )


def _lengths(samples: DataFrame) -> DataFrame:
    return samples.select(
        n_words(F.col("answer")).alias("answer_words"),
        F.col("source_length").cast("bigint").alias("context_words"),
    )


def card_lengths(samples: DataFrame) -> DataFrame:
    """One row: mean, median and 95th percentile of answer words, mean and median of
    context words, one decimal. Percentiles are exact."""
    lengths = materialize(_lengths(samples), "lengths")
    means = lengths.agg(
        F.avg("answer_words").alias("answer_mean"), F.avg("context_words").alias("context_mean")
    )
    answer = exact_percentiles(
        lengths, "answer_words", {"answer_median": 50.0, "answer_p95": 95.0}
    )
    context = exact_percentiles(lengths, "context_words", {"context_median": 50.0})
    columns = ["answer_mean", "answer_median", "answer_p95", "context_mean", "context_median"]
    return (
        means.withColumn("_a", answer.select(F.struct("*")).scalar())
        .withColumn("_c", context.select(F.struct("*")).scalar())
        .select("answer_mean", "context_mean", "_a.*", "_c.*")
        .select(*[F.bround(c, 1).alias(c) for c in columns])
    )


def class_distribution(samples: DataFrame, class_col: str = "clause_type") -> DataFrame:
    """Classes by falling count, with percent of all rows and share of the largest class."""
    counts = samples.groupBy(class_col).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.struct(F.sum("count").alias("n"), F.max("count").alias("top")).alias("t"))
    return (
        counts.withColumn("_t", totals.scalar())
        .select(
            class_col, "count",
            (100 * F.col("count") / F.col("_t.n")).alias("percent"),
            (F.col("count") / F.col("_t.top")).alias("share_of_max"),
        )
        .orderBy(F.desc("count"), class_col)
    )


def dataset_card(
    samples: DataFrame, dataset: str, targets: list[str] | None = None
) -> DataFrame:
    """The card as one nested row. What it needs of the samples is written once, without
    the texts, since the exact percentiles read it several times."""
    samples = materialize(samples.select("split", "clause_type", "answer", "source_length"), "card")
    classes = samples.groupBy("clause_type").agg(F.count(F.lit(1)).alias("n"))
    # One entry per class of the taxonomy.
    by_class = classes.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("clause_type", "n"))))
    )
    lengths = card_lengths(samples).select(F.struct("*").alias("l")).scalar()
    return (
        card_counts(samples)
        .withColumn("_l", lengths)
        .withColumn("_d", by_class.scalar())
        .select(
            F.lit(dataset).alias("dataset"),
            F.array(*[F.lit(t) for t in targets or fixed.TARGET_CLAUSES]).alias("target_clauses"),
            F.struct(*SPLITS, "total").alias("splits"),
            F.col("_d").alias("clause_distribution"),
            F.struct(
                F.col("_l.answer_mean").alias("mean"),
                F.col("_l.answer_median").alias("median"),
                F.col("_l.answer_p95").alias("p95"),
            ).alias("answer_length_stats"),
            F.struct(
                F.col("_l.context_mean").alias("mean"),
                F.col("_l.context_median").alias("median"),
            ).alias("context_length_stats"),
        )
    )


def model_comparison(
    metrics: DataFrame, tags: list[str] | None = fixed.MODEL_TAGS
) -> DataFrame:
    """One row per model of ``tags`` (None: every model): fixed columns, missing metrics 0, the
    judge's stays NULL."""
    memory = F.create_map(*[F.lit(v) for item in fixed.PEAK_MEMORY_GB.items() for v in item])

    def metric(name: str):
        known = F.col(name).cast("double") if name in metrics.columns else F.lit(None).cast("double")
        return known

    shown = metrics if tags is None else metrics.where(F.col(TAG).isin(tags))
    return shown.select(
        TAG,
        metric("geval_faithfulness").alias("geval_faithfulness"),
        *[F.coalesce(metric(name), F.lit(0.0)).alias(name) for name in COMPARED],
        F.coalesce(F.try_element_at(memory, F.col(TAG)), F.lit(0.0)).alias("vram_gb"),
    )


def best_per_metric(
    comparison: DataFrame, tags: list[str] | None = fixed.MODEL_TAGS
) -> DataFrame:
    """(model_tag, metric, value, share_of_max, is_best) over ``tags`` (None: every model);
    ties are all best.

    A window per metric over one row per model.
    """
    rows = comparison if tags is None else comparison.where(F.col(TAG).isin(tags))
    long = rows.select(TAG, *COMPARED).unpivot([TAG], COMPARED, "metric", "value")
    per_metric = Window.partitionBy("metric")
    best = F.when(
        F.col("metric").isin(fixed.LOWER_IS_BETTER), F.min("value").over(per_metric)
    ).otherwise(F.max("value").over(per_metric))
    return long.select(
        TAG, "metric", "value",
        (F.col("value") / F.nullif(F.max("value").over(per_metric), F.lit(0.0)))
        .alias("share_of_max"),
        (F.col("value") == best).alias("is_best"),
    )


def change_from_base(comparison: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Per metric: base, the first available tuned model by priority, and the change."""
    order = priority or fixed.TUNED_PRIORITY
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(TAG))
    long = comparison.select(TAG, *COMPARED).unpivot([TAG], COMPARED, "metric", "value")
    tuned = F.when(rank > 0, rank)
    return (
        long.groupBy("metric")
        .agg(
            F.max(F.when(F.col(TAG) == "base", F.col("value"))).alias("base"),
            F.min_by(F.struct(TAG, "value"), tuned).alias("t"),
        )
        .select(
            "metric", "base",
            F.col(f"t.{TAG}").alias("tuned_tag"), F.col("t.value").alias("tuned"),
            (F.col("t.value") - F.col("base")).alias("change"),
        )
    )


def side_by_side(
    outputs: DataFrame, tuned_tag: str, id_col: str = "sample_id", base_tag: str = "base"
) -> DataFrame:
    """Both models' outputs and latencies in one row per input, NULL where one has none.

    A join of the two models' rows, so texts are never aggregated. A model with two outputs
    for an input gives a row for each.
    """

    def of(tag: str, side: str) -> DataFrame:
        return outputs.where(F.col(TAG) == tag).select(
            id_col, F.col("prediction").alias(f"{side}_output"),
            F.col("latency_ms").alias(f"latency_{side}_ms"),
        )

    return of(base_tag, "base").join(of(tuned_tag, "finetuned"), id_col, "full").select(
        id_col, "base_output", "finetuned_output", "latency_base_ms", "latency_finetuned_ms"
    )
