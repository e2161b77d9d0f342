"""Benchmark passages in documents, found with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import numbered, whole_text, without
from quillmill.llm.probminhash import mix, shingles, word_hashes
from quillmill.session import materialize

ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans"]
#: The words of a text before it is folded: A-Z are word characters too.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every other ASCII byte that is no word character into a blank.
#: All bytes of characters outside ASCII are word bytes, so UTF-8 can be read bytewise.
FOLD = bytes(
    b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 0x7F
    else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows(items: list[tuple[str, str]], size: int) -> dict[bytes, tuple[int, set[str]]]:
    """Normalised window -> (words, ids of the items that hold it)."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = folded_words(text)
        length = min(size, len(words))
        for i in range(len(words) - length + 1) if words else ():
            key = b" " + b" ".join(words[i:i + length]) + b" "
            found.setdefault(key, (length, set()))[1].add(item)
    return found


def build_automaton(items: list[tuple[str, str]], size: int) -> ahocorasick.Automaton | None:
    known = windows(items, size)
    if not known:
        return None
    automaton = ahocorasick.Automaton()
    for key, (length, ids) in known.items():
        automaton.add_word(key.decode("latin-1"), (length, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


_CACHE: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(token: str, items: list[tuple[str, str]], size: int):
    """One automaton per Python worker and block of items."""
    if token not in _CACHE:
        _CACHE.clear()
        _CACHE[token] = build_automaton(items, size)
    return _CACHE[token]


def scan(words: list[bytes], automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit word ranges (end exclusive) and the ids of the items found, in one pass."""
    if automaton is None or not words:
        return [], set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return [], set()
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    ends = np.searchsorted(blanks, [end for end, _ in found])
    items: set[str] = set()
    ranges = []
    for end, (_, (length, ids)) in zip(ends.tolist(), found):
        ranges.append((end - length, end))
        items.update(ids)
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as code points of the text as it was, end exclusive."""
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


def stored_items(benchmark: DataFrame, max_bytes: int) -> DataFrame:
    """(item, text, block): the items in blocks of at most ``max_bytes`` of text (or one item)."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        whole_text().alias("text"),
    ).distinct().withColumn("size", F.octet_length("text").cast("bigint"))
    return materialize(
        numbered(items, [], ["item", "text"], ["size"], "benchmark")
        .withColumn("block", F.expr(f"__before_size div {max_bytes}")),
        "benchmark-blocks",
    )


def item_blocks(placed: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items of ``stored_items`` block by block, one at a time."""
    blocks = placed.agg(F.max("block")).first()[0]
    for block in range(0 if blocks is None else blocks + 1):
        rows = placed.where(F.col("block") == block).select("item", "text").collect()
        if rows:
            yield [(r["item"], r["text"]) for r in rows]


def window_bits(words: list[bytes], length: int, bits: int) -> np.ndarray:
    """The four places of every window of ``length`` words in a filter of ``bits`` (a power of 2)."""
    if not length or len(words) < length:
        return np.zeros((0, 4), np.int64)
    hashes = word_hashes(b" ".join(words).decode("utf-8", "surrogateescape"))
    first = mix(shingles(hashes, length) + np.uint64(length))
    second = mix(first)
    low = np.uint64(0xFFFFFFFF)
    places = (first & low, first >> np.uint64(32), second & low, second >> np.uint64(32))
    return (np.stack(places, axis=1) & np.uint64(bits - 1)).astype(np.int64)


def window_filter(placed: DataFrame, size: int, most_bits: int) -> tuple[np.ndarray, list[int]]:
    """A bitmap that holds all windows of all items, and the lengths of windows.

    About 64 bits per window and ``most_bits`` at most, whatever the benchmark: a fuller bitmap
    lets more texts through and loses none. Spark fills it in pieces of 65,536 bits.
    """

    def lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(folded_words(t.as_py())) for t in batch.column("text")], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(n, size)), pa.array(np.maximum(n - size + 1, 1))],
                names=["length", "n"])

    found = (
        placed.select("text").mapInArrow(lengths_of, "length long, n long").where("length > 0")
        .groupBy("length").agg(F.sum("n").alias("n")).collect()
    )
    lengths = sorted(r["length"] for r in found)
    wanted = 64 * sum(r["n"] for r in found)
    bits = min(most_bits, max(1 << 16, 1 << (wanted - 1).bit_length() if wanted else 0))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                words = folded_words(text.as_py())
                at = np.unique(window_bits(words, min(size, len(words)), bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at >> 16), pa.array(at & 0xFFFF)], names=["piece", "bit"])

    def piece(rows: pa.Table) -> pa.Table:
        held = np.zeros(1 << 16, np.uint8)
        held[rows.column("bit").to_numpy()] = 1
        return pa.table({"piece": rows.column("piece").slice(0, 1),
                         "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    pieces = (
        placed.select("text").mapInArrow(places, "piece long, bit long").distinct()
        .groupBy("piece").applyInArrow(piece, "piece long, held binary")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        bitmap[r["piece"] * 8192:(r["piece"] + 1) * 8192] = np.frombuffer(r["held"], np.uint8)
    return bitmap, lengths


def may_hold(words: list[bytes], bitmap: np.ndarray, lengths: list[int]) -> bool:
    """Whether a window of one of the ``lengths`` is in the bitmap; never a false no."""
    for length in lengths:
        at = window_bits(words, length, len(bitmap) * 8)
        inside = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        if inside.all(axis=1).any():
            return True
    return False


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: float = 0.05,
    max_block_bytes: int = 512 << 10,
    most_filter_bits: int = 1 << 30,
) -> DataFrame:
    """Mark the words of ``docs`` that lie in a passage of a benchmark item.

    Texts are normalised to lower-case words (digits, a-z, and everything outside ASCII)
    joined by single blanks. The windows of ``window`` words of all items (an item of fewer
    words is one window) form one automaton, and a text is scanned once, whole. Adds
    n_words, n_hit (words inside an occurrence), n_items and ``items`` (sorted ids as
    text), items_sha256, ``hit_spans`` (code points of the original text) and
    ``contaminated``: n_hit > 0 and n_hit >= share * n_words.

    A benchmark beyond ``max_block_bytes`` has an automaton per block, so that no task holds
    more than one. The texts are then read once through a bitmap of all windows (at most
    ``most_filter_bits``, broadcast), and only those that may hold one are written and
    scanned with the automaton of each block; the hits of a document are
    united by (doc_id, text). A NULL text has no words; a NULL item id is listed as "null";
    repeated items count once. Every row is returned, repeated ones too, with all columns; a
    column that clashes with an added one is replaced.
    """
    clean = without(docs, ADDED)
    text_column = next(c for c in clean.columns if c.lower() == "text")
    least = Fraction(str(share))
    hit = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                    T.StructField("end", T.LongType())]))
    schema = T.StructType([
        *clean.schema.fields, T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", hit),
    ])
    arrow_hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def digest(text: str, words: list[bytes], ranges, items: set[str]) -> tuple:
        listed = sorted(items)
        n_hit = sum(b - a for a, b in ranges)
        return (len(words), n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(),
                n_hit > 0 and n_hit * least.denominator >= least.numerator * len(words), listed,
                original_spans(text, ranges) if ranges else [])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()),
             arrow_hit]

    def finished(batch: pa.RecordBatch, columns: list, rows: list[tuple]) -> pa.RecordBatch:
        extra = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, *extra], names=schema.names)

    placed = stored_items(benchmark, max_block_bytes)
    blocks = item_blocks(placed)
    first, second = next(blocks, []), next(blocks, None)

    if second is None:
        token = uuid.uuid4().hex

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(token, first, window)
            for whole in batches:
                for start in range(0, whole.num_rows, 1000):
                    batch = whole.slice(start, 1000)
                    rows = []
                    for value in batch.column(text_column):
                        text = value.as_py() or ""
                        words = folded_words(text)
                        rows.append(digest(text, words, *scan(words, automaton)))
                    yield finished(batch, batch.columns, rows)

        return clean.mapInArrow(one_pass, schema)

    keyed = clean.withColumn("__key", F.md5(F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), whole_text())))
    hits_schema = "__key string, ranges array<struct<start: long, end: long>>, items array<string>"

    bitmap, lengths = window_filter(placed, window, most_filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [may_hold(folded_words(v.as_py()), shared.value, lengths)
                    for v in batch.column("__text")]
            yield batch.filter(pa.array(held, pa.bool_()))

    texts = materialize(
        keyed.select("__key", whole_text().alias("__text"))
        .mapInArrow(candidates, "__key string, __text string").distinct(),
        "benchmark-candidates",
    )

    def scan_block(items: list[tuple[str, str]]) -> DataFrame:
        token = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(token, items, window)
            for batch in batches:
                keys, ranges, ids = [], [], []
                for key, value in zip(batch.column("__key"), batch.column("__text")):
                    got, names = scan(folded_words(value.as_py()), automaton)
                    if got:
                        keys.append(key.as_py())
                        ranges.append([{"start": a, "end": b} for a, b in got])
                        ids.append(sorted(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(ranges, arrow_hit),
                     pa.array(ids, pa.list_(pa.string()))], names=["__key", "ranges", "items"])

        return materialize(texts.mapInArrow(run, hits_schema), "benchmark-hits")

    found = scan_block(first).unionByName(scan_block(second))
    for items in blocks:
        found = found.unionByName(scan_block(items))
    # Repeated rows were scanned as one.
    united = (
        found.groupBy("__key")
        .agg(F.flatten(F.collect_list("ranges")).alias("__ranges"),
             F.flatten(F.collect_list("items")).alias("__items"))
    )
    joined = keyed.join(united, "__key", "left").drop("__key")

    columns = clean.columns

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, ranges, items in zip(
                batch.column(text_column), batch.column("__ranges"), batch.column("__items")
            ):
                text = value.as_py() or ""
                hits = merged([(r["start"], r["end"]) for r in ranges.as_py() or []])
                rows.append(digest(text, folded_words(text), hits, set(items.as_py() or [])))
            yield finished(batch, [batch.column(c) for c in columns], rows)

    return joined.mapInArrow(last_pass, schema)
