"""From question-answer records to clause samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import cut_words, n_words, once, strip, text_or_empty


def clause_class(question: Column) -> Column:
    """The class of the first keyword, in list order, that the question contains."""
    lowered = F.lower(text_or_empty(question))
    chain = F
    for keyword, label in fixed.CLAUSE_KEYWORDS:
        chain = chain.when(F.contains(lowered, F.lit(keyword)), F.lit(label))
    return chain.otherwise(F.lit(fixed.OTHER_CLAUSE))


def is_target(label: Column, targets: list[str] | None = None) -> Column:
    return label.isin(targets or fixed.TARGET_CLAUSES)


def first_answer(answers: Column, default: str = fixed.NO_ANSWER) -> Column:
    """The first answer; the default replaces a missing or empty list, not an empty text."""
    return F.when(F.size(answers) > 0, F.get(answers, F.lit(0))).otherwise(F.lit(default))


def long_enough(text: Column, min_words: int = fixed.MIN_WORDS) -> Column:
    return n_words(text) >= min_words


def cut_context(
    text: Column, count: Column | None = None, max_words: int = fixed.MAX_WORDS
) -> Column:
    """``count`` is the number of words of ``text``, if a column holds it already."""
    n = n_words(text) if count is None else count
    return cut_words(text, n, max_words, fixed.CUT_MARKER)


def flatten_qa(
    records: DataFrame,
    id_col: str = "sample_id",
    min_words: int = fixed.MIN_WORDS,
    max_words: int = fixed.MAX_WORDS,
    targets: list[str] | None = None,
) -> DataFrame:
    """QA records (id, context, question, answers.text) to clause samples.

    Narrow: the class and length gates run before the cut, nothing is shuffled. The
    length is that of the cut text, so a cut row counts the marker as a word.
    """
    marker_words = len(fixed.CUT_MARKER.split())
    tagged = records.select(
        id_col,
        "context",
        "question",
        first_answer(F.col("answers.text")).alias("answer"),
        clause_class(F.col("question")).alias("clause_type"),
    )
    kept = (
        tagged.where(is_target(F.col("clause_type"), targets))
        .withColumn("_words", once(n_words(F.col("context"))))
        .where(F.col("_words") >= min_words)
    )
    n = F.col("_words")
    return kept.select(
        id_col,
        "clause_type",
        cut_context(F.col("context"), n, max_words).alias("contract_text"),
        strip(F.col("answer")).alias("answer"),
        strip(F.col("question")).alias("question"),
        F.when(n > max_words, F.lit(max_words + marker_words).cast("bigint")).otherwise(n)
        .alias("source_length"),
    )
