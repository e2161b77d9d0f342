"""Metrics over (model_tag, sample_id) rows. Scores of external models come as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import (
    first_words, mentions, once, prefix, sentences, text_or_empty,
)

TAG = "model_tag"


def align(predictions: DataFrame, references: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Predictions of every model next to the reference row of the same id."""
    return predictions.join(references, id_col)


def prediction_rows(
    aligned: DataFrame, id_col: str = "sample_id", prompt_chars: int | None = fixed.PROMPT_CHARS
) -> DataFrame:
    """The stored form of predictions; the prompt is cut to ``prompt_chars``, None keeps it whole."""
    prompt = F.col("prompt") if prompt_chars is None else prefix(F.col("prompt"), prompt_chars)
    return aligned.select(
        TAG, id_col, prompt.alias("prompt"), "reference", "prediction", "clause_type", "bertscore_f1"
    )


# --- similarity -----------------------------------------------------------------------


def similarity_summary(scored: DataFrame) -> DataFrame:
    """Means of precision, recall and F1 and the sample deviation of F1, per model."""
    return scored.groupBy(TAG).agg(
        F.avg("precision").alias("bertscore_precision"),
        F.avg("recall").alias("bertscore_recall"),
        F.avg("f1").alias("bertscore_f1"),
        F.stddev_samp("f1").alias("bertscore_f1_std"),
    )


# --- presence -------------------------------------------------------------------------


def reference_absent(reference: Column) -> Column:
    known = text_or_empty(reference)
    return F.startswith(known, F.lit("No ")) | mentions(known, "not found")


def prediction_absent(prediction: Column, clause_type: Column) -> Column:
    named = F.concat(F.lit("no "), F.lower(text_or_empty(clause_type)))
    return (
        mentions(prediction, "not found")
        | mentions(prediction, "not present")
        | mentions(prediction, named)
    )


def with_presence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ref_absent", reference_absent(F.col("reference"))).withColumn(
        "pred_absent", prediction_absent(F.col("prediction"), F.col("clause_type"))
    )


def presence_accuracy(rows: DataFrame) -> DataFrame:
    """Per model (``overall`` = 1, four decimals) and per class (three decimals), in one pass."""
    match = (F.col("ref_absent") == F.col("pred_absent")).cast("double")
    return (
        with_presence(rows)
        .groupingSets([[TAG], [TAG, "clause_type"]], TAG, "clause_type")
        .agg(
            F.grouping("clause_type").cast("bigint").alias("overall"),
            F.count(F.lit(1)).alias("rows"),
            F.avg(match).alias("_accuracy"),
        )
        .withColumn(
            "accuracy",
            F.when(F.col("overall") == 1, F.bround("_accuracy", 4))
            .otherwise(F.bround("_accuracy", 3)),
        )
        .drop("_accuracy")
    )


# --- grounding ------------------------------------------------------------------------


def sentence_pairs(
    rows: DataFrame,
    id_col: str = "sample_id",
    premise_words: int = fixed.PREMISE_WORDS,
    max_chars: int = fixed.PAIR_CHARS,
    legacy_cut: bool = False,
) -> DataFrame:
    """(model_tag, id, sentence_no, sentence, pair): scorer inputs, one per sentence.

    The pair is "premise [SEP] sentence" within ``max_chars``. By default the premise
    gives way and the sentence stays whole; ``legacy_cut`` cuts the end of the pair, which
    for long contracts removes the very sentence that is to be judged.
    """
    premise = first_words(F.col("contract_text"), premise_words)
    exploded = rows.select(
        TAG, id_col, premise.alias("premise"),
        F.posexplode(sentences(F.col("prediction"))).alias("sentence_no", "sentence"),
    )
    hypothesis = F.concat(F.lit(" [SEP] "), F.col("sentence"))
    if legacy_cut:
        pair = prefix(F.concat("premise", hypothesis), max_chars)
    else:
        room = F.greatest(F.lit(0), F.lit(max_chars) - F.length(hypothesis))
        pair = F.concat(F.substring(F.col("premise"), F.lit(1), room), hypothesis)
    return exploded.select(TAG, id_col, "sentence_no", "sentence", pair.alias("pair"))


def verdict(scores: Column) -> Column:
    """grounded, contradicted or ungrounded from a label -> score map, labels in any case."""
    upper = F.transform_keys(scores, lambda k, _: F.upper(k))

    def score(label: str) -> Column:
        return F.coalesce(F.try_element_at(upper, F.lit(label)), F.lit(0.0))

    return (
        F.when(score("ENTAILMENT") >= 0.5, "grounded")
        .when(score("CONTRADICTION") >= 0.5, "contradicted")
        .otherwise("ungrounded")
    )


def grounding_rates(judged: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Rates over the sentences of a model from rows (model_tag, verdict).

    A model of ``models`` without a sentence gets zero rates.
    """
    counted = judged.groupBy(TAG).agg(
        F.count(F.lit(1)).alias("total_sentences"),
        F.count_if(F.col("verdict") == "grounded").alias("_grounded"),
        F.count_if(F.col("verdict") == "contradicted").alias("_contradicted"),
    )
    if models is not None:
        counted = models.select(TAG).distinct().join(counted, TAG, "left")
    n = F.coalesce("total_sentences", F.lit(0))

    def rate(count: Column) -> Column:
        return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(count / n, 4))

    return counted.select(
        TAG,
        rate(n - F.col("_grounded")).alias("hallucination_rate"),
        rate(F.col("_grounded")).alias("grounded_rate"),
        rate(F.col("_contradicted")).alias("contradiction_rate"),
        n.cast("bigint").alias("total_sentences"),
    )


# --- calibration ----------------------------------------------------------------------


def sequence_confidence(log_probs: Column) -> Column:
    """exp of the mean top log-probability, inside [0, 1]; 0.5 for an empty sequence."""
    total = F.aggregate(log_probs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    mean = total / F.size(log_probs)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean)))
    return F.when(F.size(log_probs) > 0, bounded).otherwise(F.lit(0.5))


def is_accurate(f1: Column) -> Column:
    return (f1 > fixed.ACCURATE_F1).cast("double")


def bin_edges(n_bins: int) -> list[float]:
    """Equal steps the way linspace takes them: 0.30000000000000004, and 1.0 exactly."""
    return [i * (1 / n_bins) for i in range(n_bins)] + [1.0]


def bin_index(confidence: Column, n_bins: int, close_last: bool = False) -> Column:
    """Zero-based half-open bin, NULL outside. A confidence of 1.0 is outside by default."""
    edges = bin_edges(n_bins)
    passed = reduce(
        lambda acc, e: acc + (confidence >= e).cast("int"), edges[1:-1], F.lit(0)
    )
    inside = confidence <= 1.0 if close_last else confidence < 1.0
    return F.when((confidence >= 0.0) & inside, passed)


def _bin_means(rows: DataFrame, n_bins: int, close_last: bool) -> DataFrame:
    return (
        rows.select(TAG, "accurate", once(F.col("confidence")).alias("confidence"))
        .withColumn("bin", bin_index(F.col("confidence"), n_bins, close_last))
        .where(F.col("bin").isNotNull())
        .groupBy(TAG, "bin")
        .agg(
            F.avg("accurate").alias("accuracy"),
            F.avg("confidence").alias("confidence"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def reliability_bins(
    rows: DataFrame, n_bins: int = fixed.ECE_BINS, close_last: bool = False
) -> DataFrame:
    """Per model and non-empty bin: edges, count, mean accuracy and confidence, three decimals."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    return _bin_means(rows, n_bins, close_last).select(
        TAG, "bin",
        F.round(F.get(edges, F.col("bin")), 2).alias("bin_lower"),
        F.round(F.get(edges, F.col("bin") + 1), 2).alias("bin_upper"),
        F.bround("accuracy", 3).alias("accuracy"),
        F.bround("confidence", 3).alias("confidence"),
        "count",
    )


def calibration_error(
    rows: DataFrame, n_bins: int = fixed.ECE_BINS, close_last: bool = False
) -> DataFrame:
    """ECE per model, four decimals. Rows outside all bins still count in the total."""
    bins = _bin_means(rows, n_bins, close_last).groupBy(TAG).agg(
        F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("_gap")
    )
    totals = rows.groupBy(TAG).agg(F.count(F.lit(1)).alias("n_samples"))
    gap = F.coalesce("_gap", F.lit(0.0)) / F.col("n_samples")
    return totals.join(bins, TAG, "left").select(
        TAG, F.bround(gap, 4).alias("ece"), "n_samples"
    )


def held_out_perplexity(losses: DataFrame, run_col: str) -> DataFrame:
    """exp of the mean held-out loss of a run."""
    return losses.groupBy(run_col).agg(
        F.avg("loss").alias("eval_loss"), F.exp(F.avg("loss")).alias("eval_perplexity")
    )


