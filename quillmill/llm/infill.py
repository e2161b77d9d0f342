"""Fill-in-the-middle rows: texts cut at whole units by one counted, possessive pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import whole_text, without

ADDED = ["n", "form", "output", "prefix_chars", "middle_chars"]
LINE = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _draws(seed: int, n: int) -> list[Column]:
    """The first ``n`` 32-bit numbers of the digest of (seed, doc_id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return [F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("bigint")
            for i in range(n)]


def _replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def infill(
    docs: DataFrame,
    unit: str = LINE,
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
) -> DataFrame:
    """Rearrange every text as prefix, suffix, middle, cut between units.

    ``unit`` is a Java pattern that matches a text piece by piece without gaps (lines by
    default), without capturing groups. The number n of units picks two cuts a <= b by the
    digest of (seed, doc_id); the pattern of the row, ``(unit){a}+ (unit){b-a}+ rest``,
    takes exactly that many units and never gives one back, so one linear match finds all
    three pieces and the replacement puts them in order: psm is P prefix S suffix M middle,
    spm is S suffix P prefix M middle. Matching needs no stack per unit.

    Adds n, form, output, prefix_chars and middle_chars (code points; NULL if plain). Plain
    rows keep the text: empty and NULL texts (output ""), those that hold a marker, and
    100 - ``percent`` of a hundred. A NULL doc_id draws as "null"; equal ids draw alike.
    Every row is kept with its columns; one that clashes with an added name is replaced.
    """
    p, s, m = markers
    if not all(markers) or any(a in b for a in markers for b in markers if a is not b):
        raise ValueError("markers must be non-empty and not contain each other")
    h1, h2, h3, h4 = _draws(seed, 4)
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(F.col("__text"), F.lit(marker))
    counted = without(docs, ADDED).withColumn("__text", whole_text()).withColumn(
        "n", F.regexp_count("__text", F.lit(unit)).cast("bigint")
    )
    cut = counted.select(
        "*",
        F.when((F.col("__text") == "") | marked | (h3 % 100 >= percent), PLAIN)
        .when(h4 % 100 < spm_percent, SPM).otherwise(PSM).alias("form"),
        F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("__a"),
        F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("__b"),
    )
    pattern = F.format_string(
        rf"(?s)\A((?:{unit.replace('%', '%%')}){{%d}}+)((?:{unit.replace('%', '%%')}){{%d}}+)(.*+)\z",
        F.col("__a"), F.col("__b") - F.col("__a"),
    )
    q, t, r = (_replacement(x) for x in markers)
    order = F.when(F.col("form") == PSM, f"{q}$1{t}$3{r}$2").otherwise(f"{t}$3{q}$1{r}$2")
    turned = cut.withColumn(
        "output",
        F.when(F.col("form") == PLAIN, F.col("__text"))
        .otherwise(F.regexp_replace("__text", pattern, order)),
    )
    # The text holds no marker, so that each one stands where it was put.
    at_p, at_s, at_m = (F.instr("output", x).cast("bigint") for x in markers)
    prefix = F.when(F.col("form") == PSM, at_s - at_p).when(F.col("form") == SPM, at_m - at_p)
    middle = F.when(F.col("form") != PLAIN, F.length("output") - at_m + 1 - len(m))
    return turned.select(
        *[c for c in turned.columns if not c.startswith("__")],
        (prefix - len(p)).alias("prefix_chars"), middle.cast("bigint").alias("middle_chars"),
    )


def restore(
    rows: DataFrame, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), out: str = "restored"
) -> DataFrame:
    """Add the text that ``output`` and ``form`` came from. NULL gives NULL."""
    p, s, m = (rf"\Q{x}\E" for x in markers)
    psm = F.regexp_replace("output", rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace("output", rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return rows.withColumn(
        out,
        F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm)
        .otherwise(F.col("output")),
    )
