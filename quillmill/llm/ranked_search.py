"""Ranked lexical search: impact-sorted lists read from the top until the answer is certain."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import numbered, whole_text
from quillmill.llm.decontaminate import folded_words
from quillmill.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Postings that a task sorts at once (a document of more is sorted alone).
SEGMENT_POSTINGS = 1 << 21
FIRST_READ = 64


class Found:
    """The k best documents of one item so far, best first; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """A score below this cannot enter; an equal one can, by its id."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, rows: list[tuple[int, object]]) -> None:
        self.rows = sorted(
            self.rows + rows, key=lambda r: (-r[0], r[1] is not None, r[1])
        )[:self.k]


def nra(
    lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int,
    first_read: int = FIRST_READ,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of documents 0 .. n_docs - 1 with a score of ``floor`` or more.

    ``lists`` are (documents, impacts), by falling impact. Each round reads the next part of
    every list. The last impact read bounds what a list still holds, so the score of a
    document lies between the sum of its impacts read and that plus the bounds of the lists
    where it was not met. The k-th best lower end is the bar. Once the bounds of all lists
    together are below it, a document not met yet cannot enter; one whose upper end is below
    it leaves. Reading goes on, for the documents left, until each of their intervals is a
    single number; so scores and ties are exact. Equal scores go by ascending number.
    Returns documents, scores and the number of postings read.
    """
    lower = np.zeros(n_docs, np.int64)
    met = np.zeros((len(lists), n_docs), bool)
    bounds = np.array([int(impacts[0]) for _, impacts in lists], np.int64)
    at, size, reads = [0] * len(lists), first_read, 0
    left: np.ndarray | None = None  # documents that can still enter, once that is settled
    alive = np.ones(n_docs, bool)
    while bounds.any():
        for i, (documents, impacts) in enumerate(lists):
            if not bounds[i]:
                continue
            end = min(at[i] + size, len(documents))
            part, gains = documents[at[i]:end], impacts[at[i]:end]
            reads += end - at[i]
            bounds[i] = impacts[end - 1] if end < len(documents) else 0
            at[i] = end
            if left is not None:
                wanted = alive[part]
                part, gains = part[wanted], gains[wanted]
            lower[part] += gains
            met[i, part] = True
        size *= 2
        rest = int(bounds.sum())
        known = lower if left is None else lower[left]
        bar = floor
        if len(known) >= k:
            bar = max(bar, int(np.partition(known, len(known) - k)[len(known) - k]))
        if left is None:
            if rest >= bar:
                continue
            left = np.flatnonzero((lower > 0) & (lower + rest >= bar))
        upper = lower[left] + bounds @ ~met[:, left]
        left = left[upper >= bar]
        alive[:] = False
        alive[left] = True
        if not (bounds @ ~met[:, left]).any():
            break
    if left is None:
        left = np.flatnonzero(lower >= floor)
    left = left[lower[left] >= floor]
    best = left[np.lexsort((left, -lower[left]))[:k]]
    return best, lower[best], reads


def segment_lists(
    doc: np.ndarray, term: np.ndarray, impact: np.ndarray
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term -> (documents, impacts) by falling impact, without impacts of 0."""
    some = impact > 0
    doc, term, impact = doc[some], term[some], impact[some]
    order = np.lexsort((doc, -impact, term))
    doc, term, impact = doc[order], term[order], impact[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, int)
    ends = np.r_[starts[1:], len(term)]
    return {int(term[a]): (doc[a:b], impact[a:b]) for a, b in zip(starts, ends)}


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of every item, those of all its rows together."""
    lowered = F.translate(whole_text(), UPPER, LOWER)
    return (
        queries.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
                       .alias("term"))
        .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    )


def term_counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of a text and the wanted ones with their counts."""
    id_type = docs.schema["doc_id"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n", T.LongType()),
        T.StructField("terms", ints), T.StructField("tfs", ints),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sizes, terms, tfs = [], [], []
                for value in batch.column("text"):
                    words = folded_words(value.as_py())
                    sizes.append(len(words))
                    counts = Counter(words)
                    if len(counts) < len(numbers):
                        got = {numbers[w]: c for w, c in counts.items() if w in numbers}
                    else:
                        got = {numbers[w]: counts[w] for w in numbers.keys() & counts.keys()}
                    terms.append(list(got))
                    tfs.append(list(got.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                    names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_per_task(
    counted: DataFrame, items: dict[int, list[tuple[int, int]]], weights: np.ndarray,
    n_all: int, terms_all: int, k: int, k1_tenths: int, b_percent: int,
) -> DataFrame:
    """(item, doc_id, score): of every task, the k best documents of every item.

    A task reads its documents in segments, builds the impact-sorted lists of each, and
    starts the search of a segment with the bar that the earlier ones have set.
    """
    schema = T.StructType([
        T.StructField("item", T.LongType()), counted.schema["doc_id"],
        T.StructField("score", T.LongType()),
    ])

    def impacts(term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - b_percent + (b_percent * n * n_all) // terms_all
        return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + k1_tenths * m))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
            cut = 0
            while cut < batch.num_rows:
                before = sizes[cut - 1] if cut else 0
                end = int(np.searchsorted(sizes, before + SEGMENT_POSTINGS, "right"))
                end = max(end, cut + 1)
                yield batch.slice(cut, end - cut)
                cut = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {item: Found(k) for item in items}
        id_type = None
        for part in segments(batches):
            ids = part.column("doc_id")
            id_type = ids.type
            ordered = pc.sort_indices(ids, null_placement="at_start").to_numpy()
            place = np.empty(len(ids), np.int64)
            place[ordered] = np.arange(len(ids))
            lengths = pc.list_value_length(part.column("terms")).to_numpy()
            row = np.repeat(np.arange(len(ids)), lengths)
            term = part.column("terms").flatten().to_numpy().astype(np.int64)
            tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
            n = part.column("n").to_numpy()[row]
            lists = segment_lists(place[row], term, impacts(term, tf, n))
            for item, wanted in items.items():
                mine = [(lists[t][0], lists[t][1] * times) for t, times in wanted if t in lists]
                if not mine:
                    continue
                best, scores, _ = nra(mine, len(ids), k, found[item].floor)
                found[item].add([
                    (int(s), ids[int(ordered[d])].as_py()) for d, s in zip(best, scores)
                ])
        rows = [(item, d, s) for item, f in found.items() for s, d in f.rows]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], id_type),
                 pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    k1_tenths: int = 12,
    b_percent: int = 25,
    block_terms: int = 1 << 20,
) -> DataFrame:
    """The ``k`` best documents for every item of ``queries``: item_id, rank, doc_id, score.

    Terms are runs of digits, a-z (A-Z lower-cased) and everything outside ASCII. A term's
    weight is floor(1000 ln((2N+2)/(2df+1))), its impact in a document weight * ((10^9 tf)
    div (1000 tf + k1 m)) with the length factor m = 100 - b + (b n N) div L; a score is the
    sum over the item's terms, repeats included. N, L and df cover all documents.

    One scan of the texts stores each document's counts of the query terms. Every task then
    searches its documents by ``nra`` and hands on k rows an item at most; Spark ranks those.
    Only counts of terms and those rows are shuffled. Items are searched in blocks of
    ``block_terms`` (item, term) rows, each with a scan, so that a task never holds more (or
    one item of more); 200 items of 46 KB are one block of 7,000.

    Rows of one item_id are one item with the terms of all; a NULL item_id is an item too.
    Every row of ``docs`` is a document, repeated ones too; ties of score go by ascending
    doc_id, NULL first, equal ids in any order. NULL and empty texts have no term and count
    nowhere. Items without a matching document have no row; other columns are not read.
    """
    spark = docs.sparkSession
    terms = materialize(query_terms(queries), "query-terms")
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    placed = materialize(
        numbered(sizes, [], ["item_id"], ["size"], "query-items").select(
            "item_id", F.col("__idx").alias("item"),
            F.expr(f"__before_size div {block_terms}").alias("block"),
        ), "query-blocks",
    )
    wanted = materialize(
        terms.join(placed, terms["item_id"].eqNullSafe(placed["item_id"]))
        .select("block", "item", "term", "n"), "query-numbers",
    )
    blocks = [r[0] for r in placed.select("block").distinct().orderBy("block").collect()]
    parts = []
    for block in blocks:
        rows = wanted.where(F.col("block") == block).select("item", "term", "n").collect()
        names = sorted({r["term"] for r in rows})
        numbers = {name.encode(): i for i, name in enumerate(names)}
        items: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(rows):
            items.setdefault(r["item"], []).append((numbers[r["term"].encode()], r["n"]))
        counted = materialize(term_counts(docs, numbers), "term-counts")
        total = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total[0]:
            break
        weights = np.zeros(len(names), np.int64)
        for t, df in (counted.select(F.explode("terms").alias("t")).groupBy("t")
                      .agg(F.count(F.lit(1))).collect()):
            weights[t] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1)))
        found = best_per_task(counted.where("size(terms) > 0"), items, weights, total[0],
                              total[1], k, k1_tenths, b_percent)
        parts.append(found if len(blocks) == 1 else materialize(found, "found"))
    if not parts:
        kinds = T.StructType([queries.schema["item_id"], T.StructField("rank", T.IntegerType()),
                              docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return spark.createDataFrame([], kinds)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(placed, "item").select("item_id", "rank", "doc_id", "score")
