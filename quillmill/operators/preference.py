"""Preference pairs: a correct answer next to a degraded one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.draws import draw, draw_key, pick
from quillmill.functions.text import first_words, n_words, text_or_empty
from quillmill.operators.scale import dense_index, null_safe_key
from quillmill.session import materialize

ROWS_PER_ANSWER = 10_000


def is_eligible(answer: Column) -> Column:
    """A present clause: there is an answer and it does not start with "No "."""
    known = text_or_empty(answer)
    return (known != "") & ~F.startswith(known, F.lit("No "))


def strategy(id_col: Column, seed: int = fixed.SEED) -> Column:
    return pick(fixed.STRATEGIES, draw(seed, "strategy", id_col))


def truncated(answer: Column, id_col: Column, seed: int = fixed.SEED) -> Column:
    """The first k words and a marker, k drawn from a quarter to a half of the words."""
    n = n_words(answer)
    low, high = F.floor(n / 4), F.floor(n / 2)
    k = (low + draw(seed, "cut", id_col) % (high - low + 1)).cast("int")
    return F.when(
        n > 10, F.concat(first_words(answer, k), F.lit(fixed.INCOMPLETE_MARKER))
    ).otherwise(F.lit(fixed.SHORT_REJECTION))


def swap_matches(
    text: Column, pattern: str, options: list[str], salt: str, id_col: Column, seed: int
) -> Column:
    """Replace every match of ``pattern``, each with its own draw from ``options``."""
    pieces = F.split(text_or_empty(text), pattern)
    return F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i == 0, piece).otherwise(
                F.concat(pick(options, draw(seed, salt, id_col, i)), piece)
            ),
        ),
        "",
    )


def swap_entities(answer: Column, id_col: Column, seed: int = fixed.SEED) -> Column:
    """Other years and other company names; a text with neither is returned as it is."""
    years = swap_matches(
        answer, f"(?U){fixed.YEAR_PATTERN}", fixed.FAKE_YEARS, "year", id_col, seed
    )
    return swap_matches(
        years, f"(?U){fixed.PARTY_PATTERN}", fixed.FAKE_PARTIES, "party", id_col, seed
    )


def wrong_class_answers(
    samples: DataFrame, requests: DataFrame, id_col: str, class_col: str,
    answer_col: str, seed: int = fixed.SEED,
) -> DataFrame:
    """(id, rejected) for each request: a random answer of a random other class.

    ``requests`` (id, class) asks, all of ``samples`` can be picked, absent answers
    included; rows without a class are a class of their own. Classes are numbered densely
    in the order of their names, a draw among the others steps over the own number, and answers
    are numbered densely per class, with both sorts spread over key buckets. A small class
    can be asked for by nearly every row: its answers are then repeated per salt, in
    proportion to the expected requests per answer.
    """
    named = (
        samples.groupBy(null_safe_key(class_col).alias("class"))
        .agg(F.count(F.lit(1)).alias("n_answers"))
        .select("*", F.lit(0).alias("all"), F.hex(F.encode("class", "UTF-8")).alias("name"))
    )
    n_requests = requests.agg(F.count(F.lit(1)).alias("n")).scalar()
    salts = F.ceil(n_requests / (F.col("n_answers") * ROWS_PER_ANSWER))
    # One row per class, written: the planner sends it to the tasks only if it is small.
    classes = materialize(
        dense_index(named, ["all"], "name", "number", digits=8).select(
            "class", "number", "n_answers",
            F.greatest(F.lit(1), salts).cast("int").alias("salts"),
        ),
        "classes",
    )
    n_classes = classes.agg(F.count(F.lit(1)).alias("n")).scalar()
    own = classes.select(F.col("class").alias("own"), F.col("number").alias("own_number"))
    is_other = F.col("own_number").isNull()  # a class without any answer
    others = n_classes - F.when(is_other, 0).otherwise(1)
    drawn = draw(seed, "class", F.col("id")) % F.greatest(others, F.lit(1))
    number = drawn + F.when(~is_other & (drawn >= F.col("own_number")), 1).otherwise(0)
    asked = (
        requests.select(F.col(id_col).alias("id"), null_safe_key(class_col).alias("own"))
        .join(own, "own", "left")
        .select("id", number.alias("number"))
    )
    numbered = dense_index(
        samples.select(
            null_safe_key(class_col).alias("class"),
            F.col(answer_col).alias("rejected"),
            draw_key(seed, "answers", F.col(id_col)).alias("key"),
        ),
        ["class"], "key", "index",
    ).select("class", "index", "rejected")
    offered = numbered.join(classes.select("class", "salts"), "class").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    ).drop("salts")
    wanted = (
        asked.join(classes, "number", "left")
        .withColumn("index", draw(seed, "answer", F.col("id")) % F.col("n_answers"))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        .select("id", "class", "index", "salt")
    )
    found = wanted.join(offered, ["class", "index", "salt"], "left")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("class").isNull(), F.lit(fixed.ONE_CLASS_REJECTION))
        .otherwise(F.col("rejected")).alias("rejected"),
    )


def preference_pairs(
    samples: DataFrame,
    id_col: str,
    class_col: str = "clause_type",
    answer_col: str = "answer",
    prompt_col: str = "prompt",
    seed: int = fixed.SEED,
) -> DataFrame:
    """(id, strategy, prompt, chosen, rejected), one per eligible sample.

    Two strategies are plain expressions; only the ids of the third are shuffled to the
    answers and joined back.
    """
    key, answer = F.col(id_col), F.col(answer_col)
    eligible = samples.where(is_eligible(answer)).withColumn("strategy", strategy(key, seed))
    asking = eligible.where(F.col("strategy") == "wrong_clause")
    wrong = wrong_class_answers(
        samples, asking.select(id_col, class_col), id_col, class_col, answer_col, seed
    )
    rows = eligible.select(
        id_col, "strategy", F.col(prompt_col).alias("prompt"), answer.alias("chosen")
    )
    in_place = rows.where(F.col("strategy") != "wrong_clause").withColumn(
        "rejected",
        F.when(
            F.col("strategy") == "truncate", truncated(F.col("chosen"), key, seed)
        ).otherwise(swap_entities(F.col("chosen"), key, seed)),
    )
    looked_up = rows.where(F.col("strategy") == "wrong_clause").join(wrong, id_col)
    return in_place.unionByName(looked_up)


def pair_report(pairs: DataFrame) -> DataFrame:
    """Per strategy: pairs, share of all pairs, share whose rejected text equals the chosen."""
    total = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return pairs.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.count(F.lit(1)) / total).alias("share"),
        F.avg((F.col("rejected") == F.col("chosen")).cast("double")).alias("unchanged_share"),
    )
