"""Mixing sources by temperature, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.draws import draw_key
from quillmill.llm.common import numbered, whole_text, without, word_count
from quillmill.session import materialize

ADDED = ["n_tokens", "epoch", "block", "position", "budget"]
SECTIONS, PASSES = 16, 8  # the exponent is found on a grid of 16^-8


def _measures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """Per exponent: the entropy of the mixture, its norm, and the largest of p^(a-1).

    One aggregate over the sources, one row to the driver. The terms are summed as decimals,
    so the sums do not depend on the order of the rows.
    """
    p = F.col("p")

    def exact(x: Column) -> Column:
        return F.sum(F.round(x, 15).cast("decimal(30,15)")).cast("double")

    row = shares.agg(*[
        c for i, a in enumerate(exponents) for c in (
            exact(F.pow(p, F.lit(a))).alias(f"z{i}"),
            exact(F.pow(p, F.lit(a)) * F.log(p) * a).alias(f"l{i}"),
            F.max(F.pow(p, F.lit(a - 1))).alias(f"m{i}"),
        )
    ]).first()
    out = []
    for i in range(len(exponents)):
        z = row[f"z{i}"]
        out.append((math.log(z) - row[f"l{i}"] / z, z, row[f"m{i}"]))
    return out


def _bisect(shares: DataFrame, holds: Callable[[float, float, float], bool]) -> float:
    """The smallest exponent on the grid over [0, 1] from which ``holds`` is true, else 1."""
    low, high, step = 0, SECTIONS**PASSES, SECTIONS**PASSES
    if holds(*_measures(shares, [0.0])[0]):
        return 0.0
    for _ in range(PASSES):
        step //= SECTIONS
        inner = range(low + step, high, step)
        found = _measures(shares, [i / SECTIONS**PASSES for i in inner])
        ok = [i for i, m in zip(inner, found) if holds(*m)]
        high = ok[0] if ok else high
        low = high - step
    return high / SECTIONS**PASSES


def temperature(
    shares: DataFrame,
    scale: float | None,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    p_max: float = 1.0,
) -> float:
    """The flattest exponent that meets the target entropy and the limit of repetitions.

    ``shares`` has a column ``p``. Entropy (in nats) falls and repetition falls as the
    exponent grows from 0 to 1; targets out of reach give the nearer end. ``scale`` is the
    budget as a multiple of the corpus, None for a budget that passes the largest source
    once.
    """
    exponent = 0.0
    if target_entropy is not None:
        exponent = _bisect(shares, lambda h, z, m: h <= target_entropy)
    if max_epochs is not None:
        def limited(h: float, z: float, m: float, a: float | None = None) -> bool:
            return m * scale / z <= max_epochs

        if scale is None:
            # epochs of a source = (p / p_max) ^ (a - 1), largest for the smallest share
            p_min = shares.agg(F.min("p")).first()[0]
            ratio = math.log(p_max / p_min)
            need = 0.0 if ratio == 0 else max(0.0, 1 - math.log(max(max_epochs, 1.0)) / ratio)
            grid = SECTIONS**PASSES
            low, high = -1, grid
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if mid / grid >= need else (mid, high)
            return max(exponent, high / grid)
        return max(exponent, _bisect(shares, limited))
    return exponent


def temperature_mix(
    docs: DataFrame,
    budget_tokens: int | None = None,
    target_entropy: float | None = None,
    max_epochs: float | None = 2.0,
    block_tokens: int = 1 << 20,
    seed: int = 42,
) -> DataFrame:
    """Repeat or cut the sources of ``docs`` (doc_id, text, source, ...) to tempered weights.

    The weight of a source is its share of the tokens (words) to the power of an exponent,
    normalised; see ``temperature``. ``budget_tokens=None`` chooses the smallest budget
    that passes every document at least once. A source's budget is filled with whole
    permutations of its blocks and the beginning of one more: block order is a digest of
    (seed, source, epoch, block), blocks are dealt by a digest of the row, the last
    block is cut at the document that crosses the budget. ``position`` is the number
    of tokens before the row in its source's stream; position / budget orders a stream that
    holds the weights in every stretch.

    Returns one row per copy: all columns of ``docs`` and ``n_tokens``, ``epoch``, ``block``,
    ``position``, ``budget``. A NULL source is a source of its own, NULL and empty texts have
    no tokens, a source without tokens is passed once, equal rows are interchangeable, an
    empty table gives no rows.

    Rows are dealt over (source, block), so a source of any size is spread: the number of
    blocks follows from its tokens. Sources are aggregated before any shuffle.
    """
    clean = without(docs, ADDED)
    digest = draw_key(
        seed, "mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.md5(whole_text()),
    )
    units = materialize(
        clean.select("source", word_count(whole_text()).alias("n_tokens"),
                     F.substring(digest, 1, 8).alias("__cell")),
        "mix-units",
    )
    sources = materialize(
        units.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources"
    )
    corpus, largest = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if corpus is None:
        return _empty(clean)
    if corpus == 0:
        exponent, norm, budget = 1.0, 1.0, F.lit(0).cast("bigint")
    else:
        shares = sources.where("tokens > 0").select((F.col("tokens") / corpus).alias("p"))
        p_max = largest / corpus
        scale = None if budget_tokens is None else budget_tokens / corpus
        exponent = temperature(shares, scale, target_entropy, max_epochs, p_max)
        if scale is None:
            weight = F.pow(F.col("tokens") / F.lit(largest), F.lit(exponent)) * F.lit(largest)
        else:
            norm = _measures(shares, [exponent])[0][1]
            weight = F.pow(F.col("tokens") / F.lit(corpus), F.lit(exponent)) * F.lit(
                budget_tokens / norm
            )
        budget = F.when(F.col("tokens") > 0, F.round(weight).cast("bigint")).otherwise(0)
    n_blocks = max(1, -(-largest // block_tokens))

    plan = sources.select("source", "tokens", budget.alias("budget")).withColumn(
        "full", F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(1)
    )
    block = F.pmod(F.conv(F.col("__cell"), 16, 10).cast("bigint"), F.lit(n_blocks))
    blocks = (
        units.withColumn("block", block)
        .groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    )
    renamed = plan.withColumnRenamed("source", "__s")
    # The digest orders the blocks of every epoch anew.
    streams = (
        blocks.join(renamed, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        .withColumn("last", F.when(F.col("tokens") > 0,
                                   F.expr("(budget - 1) div greatest(tokens, 1)")).otherwise(0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                  F.greatest("last", F.lit(0)))))
        .withColumn("key", draw_key(seed, "block", F.coalesce("source", F.lit("null")),
                                    F.col("epoch"), F.col("block")))
    )
    ordered = numbered(
        streams, ["source"], ["epoch", "key", "block"], ["block_tokens"], "mix-blocks"
    ).select(
        _coded(F.col("source")).alias("__src"), "block", "epoch", "budget", "full",
        F.col("__before_block_tokens").alias("__start"),
    ).where((F.col("epoch") < F.col("full")) | (F.col("__start") < F.col("budget")))

    # The running total inside a block and the join use one and the same exchange.
    rows = (
        clean.withColumn("n_tokens", word_count(whole_text()))
        .withColumn("__src", _coded(F.col("source")))
        .withColumn("__digest", digest)
        .withColumn("__cell", F.substring("__digest", 1, 8))
        .withColumn("block", block)
        .selectExpr(
            "*", "coalesce(sum(n_tokens) OVER (PARTITION BY __src, block ORDER BY __digest "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __offset"
        )
    )
    copies = rows.join(ordered, ["__src", "block"]).withColumn(
        "position", F.col("__start") + F.col("__offset")
    )
    return copies.where(
        (F.col("epoch") < F.col("full")) | (F.col("position") < F.col("budget"))
    ).select(*clean.columns, "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block",
             "position", "budget")


def _coded(source: Column) -> Column:
    """The source as a key without NULL."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _empty(clean: DataFrame) -> DataFrame:
    return clean.where("false").select(
        "*", *[F.lit(0).cast("int" if c == "epoch" else "bigint").alias(c) for c in ADDED]
    )
