"""External row scorers, and a stand-in used in tests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Scorer = Callable[[list[str], list[str]], Iterable[tuple]]


def by_length(
    batches: Iterable[pd.DataFrame], columns: list[str], batch_rows: int,
    buffer_rows: int = 4096, buffer_chars: int = 16 << 20,
) -> Iterator[pd.DataFrame]:
    """Batches of ``batch_rows`` rows of like length, from a buffer of bounded size.

    A model pads the texts of a batch to the longest. Rows are gathered over Arrow batches
    until the buffer holds ``buffer_rows`` rows or ``buffer_chars`` characters, sorted by length
    and cut. Rows keep their index.
    """
    held: list[pd.DataFrame] = []
    rows = chars = 0

    def cut() -> Iterator[pd.DataFrame]:
        whole = pd.concat(held)
        ordered = whole.iloc[whole["_length"].argsort(kind="stable")]
        for start in range(0, len(ordered), batch_rows):
            yield ordered.iloc[start:start + batch_rows].drop(columns="_length")

    for batch in batches:
        length = sum((batch[c].fillna("").str.len() for c in columns), start=0)
        batch = batch.assign(_length=length)
        begin = 0
        while begin < len(batch):
            sums = batch["_length"].iloc[begin:].cumsum().to_numpy()
            fits = max(1, min(buffer_rows - rows, int((sums <= buffer_chars - chars).sum())))
            part = batch.iloc[begin:begin + fits]
            held.append(part)
            rows, chars, begin = rows + len(part), chars + int(part["_length"].sum()), begin + fits
            if rows >= buffer_rows or chars >= buffer_chars or begin < len(batch):
                yield from cut()
                held, rows, chars = [], 0, 0
    if held:
        yield from cut()


def score_pairs(
    df: DataFrame,
    load: Callable[[], Scorer],
    keys: list[str],
    left: str,
    right: str,
    schema: str,
    batch_rows: int | None = None,
) -> DataFrame:
    """Run a scorer over two text columns and add its columns to the key columns.

    ``load`` is called once per Python task and returns the scorer, so that a model is
    loaded once and not per row; rows arrive in Arrow batches, or with ``batch_rows`` in
    batches of that many rows of like length (``by_length``).
    """
    key_type = df.select(*keys).schema
    score_type = T.StructType.fromDDL(schema)
    names = [f.name for f in score_type]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in by_length(batches, [left, right], batch_rows) if batch_rows else batches:
            a, b = batch[left].fillna("").tolist(), batch[right].fillna("").tolist()
            scores = pd.DataFrame(list(scorer(a, b)), columns=names, index=batch.index)
            yield pd.concat([batch[keys], scores], axis=1)

    return df.select(*keys, left, right).mapInPandas(
        run, T.StructType(key_type.fields + score_type.fields)
    )


def load_token_f1() -> Scorer:
    """Word overlap (precision, recall, F1) as multisets. Not a semantic score."""

    def one(prediction: str, reference: str) -> tuple[float, float, float]:
        p, r = Counter(prediction.lower().split()), Counter(reference.lower().split())
        shared = sum((p & r).values())
        precision = shared / p.total() if p else 0.0
        recall = shared / r.total() if r else 0.0
        f1 = 2 * precision * recall / (precision + recall) if shared else 0.0
        return precision, recall, f1

    return lambda predictions, references: map(one, predictions, references)
