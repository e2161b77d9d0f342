"""Text expressions with the word and strip rules of Python's ``str`` methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that str.split() and str.strip() treat as white space. Spelled out
# because \s differs between engines (no-break space, vertical tab, file separators).
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set, behind two ranges that turn most letters away at once.
SPACE = rf"[\x00-\x20\x{{80}}-\x{{3000}}&&{SPACE_CLASS}]"
# The same set once more, as the characters themselves.
SPACES = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(col: Column) -> Column:
    return F.array_remove(F.split(text_or_empty(col), f"{SPACE}+"), "")


def n_words(col: Column) -> Column:
    return F.size(words(col)).cast("bigint")


def strip(col: Column) -> Column:
    return F.btrim(text_or_empty(col), F.lit(SPACES))


def token_set(col: Column) -> Column:
    """Distinct lower-case words, sorted."""
    return F.sort_array(F.array_distinct(words(F.lower(col))))


def first_words(col: Column, n: int | Column) -> Column:
    if isinstance(n, int):  # what follows the words, and white space before them, is one part each
        parts = F.split(text_or_empty(col), f"{SPACE}+", n + 2)
        return F.array_join(F.slice(F.array_remove(parts, ""), 1, n), " ")
    return F.array_join(F.slice(words(col), 1, n), " ")


def once(col: Column) -> Column:
    """The value of ``col`` as a generated column: a filter on it does not compute it again."""
    return F.explode(F.array(col))


def cut_words(col: Column, count: Column, limit: int, marker: str) -> Column:
    """The text stripped, or its first ``limit`` words and the marker if ``count``, its
    number of words, is larger."""
    return F.when(
        count > limit, F.concat(first_words(col, limit), F.lit(marker))
    ).otherwise(strip(col))


def sentences(col: Column, min_words: int = 4) -> Column:
    """Sentences that end in . ! or ?, stripped, without those below ``min_words``."""
    parts = F.split(strip(col), rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: F.size(words(s)) >= min_words)


def mentions(col: Column, needle: str | Column) -> Column:
    """Case-blind containment; a missing text mentions nothing."""
    wanted = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text_or_empty(col)), wanted)


def prefix(col: Column, n_chars: int) -> Column:
    return F.substring(text_or_empty(col), 1, n_chars)
