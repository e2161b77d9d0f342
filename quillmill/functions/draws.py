"""Repeatable random draws: a function of (seed, salt, id), not of partition or order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, salt: str, *ids: Column) -> Column:
    """A 32-digit hexadecimal key; sorting by it is a shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[i.cast("string") for i in ids]))


def draw(seed: int, salt: str, *ids: Column) -> Column:
    """A whole number, uniform over 0 .. 2^32 - 1."""
    return F.conv(F.substring(draw_key(seed, salt, *ids), 1, 8), 16, 10).cast("bigint")


def pick(options: list[str], number: Column) -> Column:
    """The option at ``number`` modulo the number of options."""
    return F.element_at(
        F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int")
    )


def number(seed: int, salt: str, i: int) -> int:
    """The draw for a plain number, for parameters fixed before the job starts."""
    return int(hashlib.md5(f"{seed}|{salt}|{i}".encode()).hexdigest()[:8], 16)
