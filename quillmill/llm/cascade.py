"""Quality rules as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import SPACES, without

SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Measures:
    """Measures of a text, each made when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() parts at exactly \\x20 and \\x09-\\x0D; all else, NBSP too, is word.
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.fromiter(
            (known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words
        )

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five that occur twice or more, the first one included."""
        n = self.n_words
        if n <= WINDOW:
            return 0
        # Windows of 2, 4 and 5 words as exact numbers, each from two smaller ones.
        two = _renumber(self.ids[:-1], self.ids[1:])
        four = _renumber(two[:-2], two[2:])
        five = _renumber(four[:-1], self.ids[4:])
        starts = np.flatnonzero(np.bincount(five)[five] > 1)
        edge = np.zeros(n + 1, np.int64)
        edge[starts] += 1
        edge[starts + WINDOW] -= 1
        return int((np.cumsum(edge) > 0).sum())

    @cached_property
    def n_stutter(self) -> int:
        """Words equal to the word before them."""
        return int((self.ids[1:] == self.ids[:-1]).sum())


def _renumber(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A dense number per distinct pair."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


Rule = Callable[[Measures], bool]

#: True means rejected. The first two are the base rules.
RULES: dict[str, Rule] = {
    "few_words": lambda m: m.n_words < 10,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 20 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "duplicate_lines": lambda m: 2 * m.n_dup_lines > len(m.lines),
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words,
    "stutter": lambda m: 10 * m.n_stutter > 3 * m.n_words,
}
BASE = ["few_words", "repeated_windows"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rule_costs(docs: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(rule, n, rejected, nanoseconds): every rule run alone on every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rejected, spent = 0, dict.fromkeys(rules, 0), dict.fromkeys(rules, 0)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                for name, rule in rules.items():
                    fresh = Measures(text)
                    start = time.thread_time_ns()
                    rejected[name] += bool(rule(fresh))
                    spent[name] += time.thread_time_ns() - start
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(rules)), pa.array([n] * len(rules), pa.int64()),
             pa.array([rejected[r] for r in rules], pa.int64()),
             pa.array([spent[r] for r in rules], pa.int64())],
            names=["rule", "n", "rejected", "nanoseconds"],
        )

    schema = "rule string, n long, rejected long, nanoseconds long"
    return (
        docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
        .groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("n", "rejected", "nanoseconds")])
    )


def rule_order(
    docs: DataFrame, rules: dict[str, Rule], sample_rows: int, seed: int
) -> list[str]:
    """Rules by rejections per nanosecond on a sample, best first; ties by name.

    The sample has about ``sample_rows`` rows, dealt over the whole table. It decides the order
    and nothing else: a text is kept if no rule rejects it, in whatever order they run.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs if share == 1.0 else docs.sample(False, share, seed)
    # One row per rule.
    found = {r["rule"]: r for r in rule_costs(sample, rules).collect()}

    def gain(name: str) -> float:
        row = found.get(name)
        return 0.0 if row is None else row["rejected"] / max(row["nanoseconds"], 1)

    return sorted(rules, key=lambda name: (-gain(name), name))


def cascade(
    docs: DataFrame,
    rules: dict[str, Rule] | None = None,
    sample_rows: int = 2000,
    seed: int = 42,
    measures: bool = False,
) -> DataFrame:
    """Run ``rules`` over the whole texts of ``docs`` and stop at the first that rejects.

    Adds ``kept``, ``rejected_by`` (the rule that stopped the cascade; NULL if kept) and
    ``n_run`` (rules evaluated). ``kept`` does not depend on the order of the rules, the other
    two do. With ``measures`` all five measures and ``base_failed`` are added for every row,
    which costs what the short circuit saved.

    A NULL text is empty: no words, rejected by ``few_words``. All rows are returned, repeated
    ones too, with all columns; a column that clashes with an added one is replaced.
    """
    rules = dict(RULES if rules is None else rules)
    added = ["kept", "rejected_by", "n_run", "base_failed", *MEASURES]
    clean = without(docs, added)
    order = rule_order(clean, rules, sample_rows, seed)
    schema = T.StructType(
        [*clean.schema.fields, T.StructField("kept", T.BooleanType()),
         T.StructField("rejected_by", T.StringType()), T.StructField("n_run", T.IntegerType())]
    )
    if measures:
        schema = T.StructType(
            [*schema.fields, T.StructField("base_failed", T.BooleanType()),
             *[T.StructField(m, T.LongType()) for m in MEASURES]]
        )
    text_column = next(c for c in clean.columns if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield judged(batch.slice(start, 1000))

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        stopped, runs, base, values = [], [], [], {m: [] for m in MEASURES}
        for text in batch.column(text_column):
            m = Measures(text.as_py())
            by, n = None, 0
            for name in order:
                n += 1
                if rules[name](m):
                    by = name
                    break
            stopped.append(by)
            runs.append(n)
            if measures:
                base.append(any(RULES[b](m) for b in BASE))
                for key in MEASURES:
                    values[key].append(getattr(m, key))
        extra = [pa.array([s is None for s in stopped], pa.bool_()), pa.array(stopped, pa.string()),
                 pa.array(runs, pa.int32())]
        if measures:
            extra += [pa.array(base, pa.bool_()), *[pa.array(values[m], pa.int64()) for m in MEASURES]]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return clean.mapInArrow(run, schema)
