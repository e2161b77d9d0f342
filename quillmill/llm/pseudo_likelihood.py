"""Masked pseudo-likelihood: a two-sided window network predicts every word of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import without
from quillmill.llm.probminhash import mix, word_hashes
from quillmill.session import materialize

SIDE = 32  # a class is a pair (row, column) of a SIDE x SIDE table
SIDE_BITS = 5
CLASSES = SIDE * SIDE
OWN = 768  # classes that hold a single bucket of words
BUCKETS = 1 << 16  # so that a bucket is two bytes
CONTEXT = (-2, -1, 1, 2)
PAD = CLASSES  # the class beyond either end of a document
DIM, HIDDEN = 16, 32
STEEPEST = 40  # scores of rows and columns are held within this, so that none overflows
SLICE = 4_096  # positions per numpy call
SCALE = 1 << 24  # parameters are averaged as whole numbers of this unit
LOG_UNITS = 1_000_000_000  # logarithms are summed by Spark as whole numbers of this unit
HOT_SHARE, COMMON_SHARE, COMMON_BYTES, COMMON_TIMES = 1_000, 1_000_000, 64, 16  # see ``common_words``
UNSEEN = 0.5  # occurrences of a word that the training texts do not hold
DISTINCT = 1_000_000  # words that a task counts before it hands them on
KNOWN = 1 << 18  # words that a task keeps at hand when it scores
TRAINER_WORDS, TRAINERS = 1 << 21, 4_096  # see ``train``
HELD = 1 << 17  # words that a trainer mixes with each other

SHAPES = {
    "embed": (CLASSES + 1, DIM), "hidden": (len(CONTEXT) * DIM, HIDDEN), "bias": (1, HIDDEN),
    "row": (HIDDEN, SIDE), "row_bias": (1, SIDE), "column": (HIDDEN, SIDE),
    "column_bias": (SIDE, SIDE),
}
ADDED = ["n_tokens", "log_prob", "mean_log_prob"]


@dataclass
class Model:
    """``classes`` maps a bucket of words to its class; ``weights`` are the network.

    ``words`` is the written table (hash, word, n) of all words of the training texts,
    ``common`` the logarithms of the counts of the frequent ones, ``counts`` the occurrences
    per class. ``trained`` is the number of positions trained on, one per round.
    """

    classes: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    words: DataFrame | None = None
    common: dict[bytes, float] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    trained: list[int] = field(default_factory=list)


def fresh_weights(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    return {
        name: np.zeros(shape, np.float32) if name.endswith("bias")
        else (draw.standard_normal(shape) / np.sqrt(shape[0] if name != "embed" else DIM))
        .astype(np.float32)
        for name, shape in SHAPES.items()
    }


def buckets(text: str | None) -> np.ndarray:
    return (word_hashes(text) % np.uint64(BUCKETS)).astype(np.int64)


def class_table(counts: np.ndarray) -> np.ndarray:
    """Bucket -> class. The most frequent buckets have classes of their own, in order of count
    (ties by number); all others share the remaining classes by number."""
    order = np.argsort(-counts, kind="stable")[:OWN]
    table = OWN + np.arange(BUCKETS) % (CLASSES - OWN)
    own = order[counts[order] > 0]
    table[own] = np.arange(len(own))
    return table


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all documents with two pads around each, the places of words, their document."""
    pad = np.full(2, PAD)
    stream = np.concatenate([x for d in docs for x in (pad, d)] + [pad])
    lengths = np.array([len(d) for d in docs], np.int64)
    owner = np.repeat(np.arange(len(docs)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]) + 2
    return stream, _places(lengths) + np.repeat(starts, lengths), owner


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the documents of these lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _stream(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _joined([classes[buckets(t)] for t in texts])


def _forward(w: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray) -> tuple:
    """Scores of the rows and columns of the classes at ``at``, and what led there.

    Both sides are seen, the word itself is masked: it is in no input of its own prediction.
    """
    around = np.take(stream, at[:, None] + np.array(CONTEXT))
    inputs = np.take(w["embed"], around, axis=0).reshape(len(at), -1)
    hidden = inputs @ w["hidden"]
    hidden += w["bias"]
    np.tanh(hidden, out=hidden)
    here = np.take(stream, at)
    row, column = here >> SIDE_BITS, here & (SIDE - 1)
    rows = hidden @ w["row"]
    rows += w["row_bias"]
    columns = hidden @ w["column"]
    columns += np.take(w["column_bias"], row, axis=0)
    for x in (rows, columns):
        np.maximum(x, np.float32(-STEEPEST), out=x)
        np.minimum(x, np.float32(STEEPEST), out=x)
    return around, inputs, hidden, row, column, rows, columns


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], x.dtype)


def log_probs(w: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.float64)
    for i in range(0, len(at), SLICE):
        *_, row, column, rows, columns = _forward(w, stream, at[i:i + SLICE])
        n = np.arange(len(row))
        out[i:i + SLICE] = (
            rows[n, row] - np.log(_exponentials(rows)[1])
            + columns[n, column] - np.log(_exponentials(columns)[1])
        )
    return out


def _sum_by(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``at`` and the sums of the ``rows`` of each."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
    return sorted_at[first], np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)


def train_step(
    w: dict[str, np.ndarray], squares: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray,
    rate: float,
) -> None:
    """One Adagrad step on the mean negative log-probability at ``at``."""
    around, inputs, hidden, row, column, rows, columns = _forward(w, stream, at)
    n = np.arange(len(at))
    slopes = []
    for x, target in ((rows, row), (columns, column)):
        slope, total = _exponentials(x)
        slope /= total[:, None]
        slope[n, target] -= 1
        slope /= np.float32(len(at))
        slopes.append(slope)
    d_rows, d_columns = slopes
    one_hot = np.take(np.eye(SIDE, dtype=np.float32), row, axis=0)
    d_hidden = (d_rows @ w["row"].T + d_columns @ w["column"].T) * (1 - hidden * hidden)
    everywhere = slice(None)
    grads = {
        "row": (everywhere, hidden.T @ d_rows),
        "row_bias": (everywhere, d_rows.sum(0, keepdims=True)),
        "column": (everywhere, hidden.T @ d_columns),
        "column_bias": (everywhere, one_hot.T @ d_columns),
        "hidden": (everywhere, inputs.T @ d_hidden),
        "bias": (everywhere, d_hidden.sum(0, keepdims=True)),
        "embed": _sum_by(
            around.ravel().astype(np.int16), (d_hidden @ w["hidden"].T).reshape(-1, DIM)
        ),
    }
    for name, (where, g) in grads.items():
        squares[name][where] += g * g
        w[name][where] -= np.float32(rate) * g / (np.sqrt(squares[name][where]) + np.float32(1e-6))


def part_of(keys: np.ndarray, places: np.ndarray, every: int) -> np.ndarray:
    """The part, of ``every``, of positions by the key of their text and their place in it."""
    mixed = mix(keys.astype(np.uint64) + places.astype(np.uint64) * np.uint64(2654435761))
    return (mixed % np.uint64(every)).astype(np.int64)


def packed(found: np.ndarray) -> bytes:
    """Numbers below 65,536 in two bytes each, compressed, behind their number of bytes."""
    raw = found.astype("<u2").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(found: bytes) -> np.ndarray:
    size = int.from_bytes(found[:8], "little")
    return np.frombuffer(pa.decompress(found[8:], size, "zstd", asbytes=True), "<u2")


class _Numbers(dict):
    """Word -> its number, in order of appearance: one look-up gives its hash and counts it."""

    def __init__(self) -> None:
        super().__init__()
        self.hash_of = np.zeros(1 << 12, np.uint64)
        self.times = np.zeros(1 << 12, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == len(self.hash_of):
            self.hash_of = np.concatenate([self.hash_of, np.zeros_like(self.hash_of)])
        self.hash_of[number] = xxhash.xxh3_64_intdigest(word)
        return number

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def buckets(self, text: str | None) -> np.ndarray:
        """As the function ``buckets``; the words wait to be counted."""
        numbers = self.of(text)
        self.waiting.append(numbers)
        self.held += len(numbers)
        return np.take(self.hash_of, numbers) % np.uint64(BUCKETS)

    def count(self, most: int = 1 << 20) -> None:
        """Add the words seen since the last time, if there are ``most`` or more."""
        if self.held >= most:
            seen = np.bincount(np.concatenate(self.waiting), minlength=len(self.times))
            seen[:len(self.times)] += self.times
            self.times, self.waiting, self.held = seen, [], 0

    def total(self) -> dict[bytes, int]:
        """Word -> occurrences."""
        self.count(0)
        return dict(zip(self, self.times[:len(self)].tolist()))


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables from one reading of the texts, both written once.

    (hash, word, n): every word of all texts and its occurrences. (key, found): a digest of
    text and doc_id, and the ``packed`` buckets of the words of the text.
    """
    identity = [F.col(c).cast("string") for c in docs.columns if c.lower() in ("text", "doc_id")]
    texts = docs.select(F.xxhash64(*identity).alias("key"), F.col("text").cast("string").alias("text"))
    schema = "key long, found binary, word binary, n long"

    def rows(keys: list, found: list, words: dict[bytes, int]) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys + [None] * len(words), pa.int64()),
             pa.array(found + [None] * len(words), pa.binary()),
             pa.array([None] * n + list(words), pa.binary()),
             pa.array([None] * n + list(words.values()), pa.int64())],
            names=["key", "found", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Numbers()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                found = []
                for text in part.column("text"):
                    found.append(packed(words.buckets(text.as_py())))
                    words.count()
                full = len(words) > DISTINCT
                yield rows(part.column("key").to_pylist(), found, words.total() if full else {})
                if full:
                    words = _Numbers()
        if words:
            yield rows([], [], words.total())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), *batch.columns], names=["hash", "word", "n"])

    written = materialize(texts.mapInArrow(run, schema), "word-buckets")
    words = written.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.mapInArrow(hashed, "hash long, word binary, n long"), "word-counts")
    return words, written.where("found IS NOT NULL").select("key", "found")


def bucket_counts(words: DataFrame) -> np.ndarray:
    """Occurrences per bucket of words over all texts: a vector of fixed length."""
    counts = np.zeros(BUCKETS, np.int64)
    bucket = F.col("hash").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    for r in words.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def common_words(words: DataFrame, total: int) -> dict[bytes, float]:
    """Word -> ln n of the words that are scored in place.

    Above one ``HOT_SHARE``-th of all occurrences any word; above one ``COMMON_SHARE``-th those
    of at most ``COMMON_BYTES`` that occur ``COMMON_TIMES``: fewer than 1,000 and 1,000,000
    words, whatever the corpus. None of the others is hot, so these may be shuffled.
    """
    few = F.col("n") * HOT_SHARE > total
    short = (
        (F.col("n") * COMMON_SHARE > total) & (F.col("n") >= COMMON_TIMES)
        & (F.length("word") <= COMMON_BYTES)
    )
    rows = words.where(few | short).select("word", "n").collect()
    return {bytes(r["word"]): float(np.log(r["n"])) for r in rows}


def train(
    docs: DataFrame, rounds: int = 2, every: int = 2, rate: float = 0.1, batch: int = 2048,
    seed: int = 42,
) -> Model:
    """Fit the network on all texts: in every round, each trainer trains on its own, then
    weights are averaged by the number of masked positions.

    All positions of all texts are trained on: they are dealt into ``every`` parts by a
    hash of the text and the place in it, and a round takes the next part. There are as many
    rounds as parts at least; ``every`` = 1 takes all positions in every round.

    Texts are dealt to trainers by a digest of text and doc_id and read in its order, one
    trainer per ``TRAINER_WORDS`` words of the corpus (``TRAINERS`` at most, which then read
    more each). The model is thus a function of the corpus, wherever its rows are stored;
    rows equal in text and doc_id are interchangeable. (Scores may differ in the last digit,
    as single-precision products round by their height.) Models are summed by Spark; the
    driver receives one per round, of a size fixed by the constants above.
    """
    words, encoded = encode(docs)
    per_bucket = bucket_counts(words)
    total = int(per_bucket.sum())
    classes = class_table(per_bucket)
    per_class = np.bincount(classes, per_bucket, CLASSES).astype(np.int64)
    common = common_words(words, total)
    weights = fresh_weights(seed)
    names = list(SHAPES)
    trainers = min(TRAINERS, 1 + total // TRAINER_WORDS)
    dealt = encoded.repartition(trainers, "key").sortWithinPartitions("key")
    trained = []
    for turn in range(max(rounds, every)):

        def fit(
            batches: Iterator[pa.RecordBatch], turn: int = turn, start: dict = weights
        ) -> Iterator[pa.RecordBatch]:
            w = {k: v.copy() for k, v in start.items()}
            squares = {k: np.zeros_like(v) for k, v in w.items()}
            seen = 0
            for keys, docs in _held(batches):
                stream, at, owner = _joined([classes[d] for d in docs])
                places = _places(np.array([len(d) for d in docs], np.int64))
                chosen = at[part_of(keys[owner], places, every) == turn % every]
                # Documents are mixed within a batch, so that a step sees many of them.
                chosen = chosen[np.argsort(mix(chosen.astype(np.uint64) + np.uint64(turn)))]
                for i in range(0, len(chosen), batch):
                    train_step(w, squares, stream, chosen[i:i + batch], rate)
                seen += len(chosen)
            if seen:
                flat = np.concatenate([w[k].ravel() for k in names]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat))),
                     pa.array(np.round(flat * SCALE).astype(np.int64)),
                     pa.array(np.full(len(flat), seen, np.int64))], names=["i", "v", "n"])

        # Whole numbers: the average does not depend on the order in which tasks end.
        weighted = F.sum(F.col("v").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
        rows = (
            dealt.mapInArrow(fit, "i long, v long, n long").groupBy("i")
            .agg(weighted.alias("v"), F.sum("n").alias("n"))
            .select("i", (F.col("v").cast("double") / F.col("n") / SCALE).alias("v"), "n")
            .collect()
        )
        if not rows:
            continue
        flat = np.zeros(sum(np.prod(s) for s in SHAPES.values()), np.float32)
        for r in rows:
            flat[r["i"]] = r["v"]
        trained.append(rows[0]["n"])
        at = 0
        weights = {}
        for name, shape in SHAPES.items():
            weights[name] = flat[at:at + np.prod(shape)].reshape(shape)
            at += np.prod(shape)
    return Model(classes, weights, words, common, per_class, trained)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Keys and buckets of texts, in lists of about ``HELD`` words (or one text).

    Where a list ends depends on the order of the texts only, not on the batches.
    """
    keys, docs, size = [], [], 0
    for whole in batches:
        for key, found in zip(whole.column("key").to_pylist(), whole.column("found")):
            keys.append(key)
            docs.append(unpacked(found.as_py()))
            size += len(docs[-1])
            if size >= HELD:
                yield np.array(keys, np.int64).view(np.uint64), docs
                keys, docs, size = [], [], 0
    if docs:
        yield np.array(keys, np.int64).view(np.uint64), docs


def score(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """Add n_tokens, log_prob (the sum over all words of the log-probability of the word given
    two words on either side) and mean_log_prob (NULL without words).

    The network gives the probability of the word's class, the counts of the training texts that
    of the word in its class, n(word) / n(class); a word that they do not hold counts ``UNSEEN``
    occurrences. Frequent words are looked up in place, all others by a join on a 64-bit hash.

    A NULL text is empty: no tokens, log_prob 0. All rows and columns are kept, repeated rows
    too (without the text, unless ``with_text``); a column that clashes with an added one is
    replaced.
    """
    clean = without(docs, ADDED)
    text_column = next(c for c in clean.columns if c.lower() == "text")
    kept = [f for f in clean.schema.fields if with_text or f.name != text_column]
    schema = T.StructType([
        *kept, T.StructField("n_tokens", T.LongType()), T.StructField("__units", T.LongType()),
        T.StructField("__rare", T.ArrayType(T.LongType())),
        T.StructField("__times", T.ArrayType(T.LongType())),
    ])
    names = [f.name for f in kept]
    classes, weights = model.classes, model.weights
    log_counts = np.log(np.maximum(model.counts, UNSEEN))
    hashes = np.fromiter(
        map(xxhash.xxh3_64_intdigest, model.common), np.uint64, len(model.common))
    order = np.argsort(hashes)
    # One entry beyond the last, so that a search always ends on one.
    hashes = np.append(hashes[order], np.uint64(0))
    logs = np.append(np.array(list(model.common.values()), np.float64)[order], 0.0)
    n_common = len(model.common)

    def looked_up(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes of words, what their counts add to the logarithm, and which are common."""
        of = classes[(h % np.uint64(BUCKETS)).astype(np.int64)]
        spot = np.searchsorted(hashes[:n_common], h)
        common = (spot < n_common) & (hashes[spot] == h)
        return of, np.where(common, logs[spot], 0.0) - log_counts[of], common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, facts = _Numbers(), looked_up(np.zeros(0, np.uint64))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                if len(known) > KNOWN:  # forget, never grow with the corpus
                    known, facts = _Numbers(), looked_up(np.zeros(0, np.uint64))
                numbers = [known.of(v.as_py()) for v in part.column(text_column)]
                fresh = looked_up(known.hash_of[len(facts[0]):len(known)])
                facts = tuple(np.concatenate(x) for x in zip(facts, fresh))
                of, added, is_common = facts
                stream, at, owner = _joined([np.take(of, x) for x in numbers])
                n = np.bincount(owner, minlength=len(numbers))
                every = np.concatenate(numbers)
                each = log_probs(weights, stream, at) + np.take(added, every)
                total = np.bincount(owner, each, len(numbers)).astype(np.float64)
                rare, times = [], []
                for x in numbers:
                    word, k = np.unique(
                        np.take(known.hash_of, x[~np.take(is_common, x)]), return_counts=True)
                    rare.append(word.view(np.int64))
                    times.append(k)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(n.astype(np.int64)),
                     pa.array(np.round(total * LOG_UNITS).astype(np.int64)),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rare), pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int64()))],
                    names=schema.names)

    # Written with the number of the row, so that the rare words find their row again.
    scored = materialize(
        clean.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()),
        "word-scores",
    )
    units = F.round(F.log(F.col("n").cast("double")) * LOG_UNITS).cast("bigint")
    known = model.words.groupBy("hash").agg(F.sum("n").alias("n")).select("hash", units.alias("units"))
    unseen = F.lit(round(float(np.log(UNSEEN)) * LOG_UNITS))
    rare = scored.select(
        F.col("__row").alias("row"), F.explode(F.arrays_zip("__rare", "__times")).alias("w")
    ).select("row", F.col("w.__rare").alias("hash"), F.col("w.__times").alias("k"))
    sums = (
        rare.join(known, "hash", "left").groupBy(F.col("row").alias("__r"))
        .agg(F.sum(F.coalesce("units", unseen) * F.col("k")).alias("__more"))
    )
    total = (F.col("__units") + F.coalesce("__more", F.lit(0))) / F.lit(float(LOG_UNITS))
    return (
        scored.join(sums, F.col("__row") == F.col("__r"), "left")
        .withColumn("__total", F.round(total, 4))
        .select(
            *names, "n_tokens", F.col("__total").alias("log_prob"),
            F.when(F.col("n_tokens") > 0, F.round(F.col("__total") / F.col("n_tokens"), 6))
            .alias("mean_log_prob"),
        )
    )


def pseudo_likelihood(docs: DataFrame, with_text: bool = True, **parameters) -> DataFrame:
    """Train on ``docs`` and score them; see ``train`` and ``score``."""
    return score(docs, train(docs, **parameters), with_text)
