"""Near-duplicates by ProbMinHash: probability Jaccard of weighted shingles, bands, verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import shuffle_tasks, whole_text, without
from quillmill.operators.graph import component_roots
from quillmill.operators.scale import salted_join
from quillmill.session import materialize

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MAX_HEADS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:  # forget, never grow with the corpus
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word ``[^\\x20\\x09-\\x0D]+``."""
    words = (text or "").encode().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words; a shorter text is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):  # order counts: (...(w1 g + w2) g + ...) g + w5, then mixed
        out = out * GOLDEN + words[k:k + n]
    return mix(out)


def weighted(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights 1 + ln(count)."""
    found, counts = np.unique(shingles(words, size), return_counts=True)
    return found, 1.0 + np.log(counts)


def probability_jaccard(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
) -> float:
    """Sum over common i of 1 / sum over all j of max(a_j / a_i, b_j / b_i), exactly.

    Equals the Jaccard index if all weights are equal. 0 if one side has no shingles.
    """
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][at_a], b[1][at_b]
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    # Beyond i in this order a_j / a_i is the larger term, up to i it is b_j / b_i.
    beyond = np.searchsorted(ratio, ratio, side="right")
    sum_a = np.concatenate([np.cumsum(wa[::-1])[::-1], [0.0]])[beyond] + a[1].sum() - wa.sum()
    sum_b = np.concatenate([[0.0], np.cumsum(wb)])[beyond] + b[1].sum() - wb.sum()
    return float((1.0 / (sum_a / wa + sum_b / wb)).sum())


def signatures(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, registers: int
) -> np.ndarray:
    """(n_sets, registers): the element that arrives first at each register of each set.

    Every element runs a Poisson process whose rate is its weight: arrival times are sums of
    exponentials drawn from (element, arrival number) alone, and every arrival hits one register
    drawn likewise. So two sets agree at a register with the probability Jaccard as
    probability. An element is dropped as soon as its time exceeds the latest first
    arrival of its set, as it can no longer change a register: after the first round
    only few are left.
    """
    first = np.full(n_sets * registers, np.inf)
    winner = np.zeros(n_sets * registers, np.uint64)
    time = np.zeros(len(elements))
    live = np.arange(len(elements))
    arrival = np.uint64(0)
    while len(live):
        arrival += np.uint64(1)
        draw = mix(elements[live] ^ mix(np.full(1, arrival)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[live] -= np.log(uniform) / weights[live]
        cell = owner[live] * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        now = time[live]
        np.minimum.at(first, cell, now)
        leads = now == first[cell]
        winner[cell[leads]] = elements[live][leads]
        latest = first.reshape(n_sets, registers).max(axis=1)
        live = live[now < latest[owner[live]]]
    return winner.reshape(n_sets, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(n_sets, bands): one 64-bit key per band of registers."""
    rows = signature.shape[1] // bands
    keys = np.empty((signature.shape[0], bands), np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[0], np.uint64(b))
        for r in range(rows):
            key = mix(key ^ signature[:, b * rows + r])
        keys[:, b] = key
    return keys


def nibbles(signature: np.ndarray) -> np.ndarray:
    """(n_sets, words): four bits of every register, sixteen registers to a 64-bit word."""
    short = mix(signature) & np.uint64(15)
    padded = np.zeros((len(short), -(-short.shape[1] // 16) * 16), np.uint64)
    padded[:, :short.shape[1]] = short
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (padded.reshape(len(short), -1, 16) << shifts).sum(axis=2, dtype=np.uint64)


def mismatches(a: Column, b: Column, words: int) -> Column:
    """How many of the four-bit registers differ."""
    total = F.lit(0)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def most_mismatches(registers: int, threshold: float, errors: float = 3.5) -> int:
    """Differing four-bit registers of a pair at ``threshold``, plus ``errors`` standard errors."""
    share = (1 - threshold) * 15 / 16
    return math.floor(registers * share + errors * math.sqrt(registers * share * (1 - share)))


def _sketch(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(digest, doc_id, keys, nibbles): the signature of every text that has words."""
    chunk = 200_000  # shingles per numpy call

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(names: list, sets: list) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
            got = signatures(np.concatenate([s[0] for s in sets]),
                             np.concatenate([s[1] for s in sets]), owner, len(sets), bands * rows)
            def lists(values: np.ndarray) -> pa.ListArray:
                ends = np.arange(len(sets) + 1, dtype=np.int32) * values.shape[1]
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64).ravel()))

            return pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in names], pa.binary()),
                 pa.array([i for _, i in names], pa.int64()),
                 lists(band_keys(got, bands)), lists(nibbles(got))],
                names=["digest", "doc_id", "keys", "nibbles"])

        for batch in batches:
            names, sets, held = [], [], 0
            for digest, doc, text in zip(*(batch.column(c) for c in ("digest", "doc_id", "text"))):
                one = weighted(word_hashes(text.as_py()), size)
                if len(one[0]):
                    names.append((digest.as_py(), doc.as_py()))
                    sets.append(one)
                    held += len(one[0])
                if held >= chunk or len(sets) >= 500:
                    yield made(names, sets)
                    names, sets, held = [], [], 0
            if sets:
                yield made(names, sets)

    return texts.select("digest", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "digest binary, doc_id long, keys array<long>, nibbles array<long>"
    )


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, similarity): the exact probability Jaccard of the (head, member) pairs.

    A head may be paired with a third of all texts: its pairs are dealt over salts, its text is
    sent once per salt, and a task streams through members holding one head at a time.
    """
    spark = pairs.sparkSession
    tasks = shuffle_tasks(spark)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(tasks)))
    members = salted.join(texts, salted["member"] == texts["node"]).select(
        "head", "salt", "member", "text"
    )
    heads = salted.select("head", "salt").distinct()
    leaders = heads.join(texts, heads["head"] == texts["node"]).select(
        "head", "salt", F.lit(None).cast("bigint").alias("member"), "text"
    )
    rows = (
        leaders.unionByName(members).repartition(tasks, "head", "salt")
        .sortWithinPartitions("head", "salt", F.col("member").asc_nulls_first())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for h, m, t in zip(batch.column("head"), batch.column("member"), batch.column("text")):
                one = weighted(word_hashes(t.as_py()), size)
                if m.as_py() is None:
                    head, held = h.as_py(), one
                else:
                    found.append((head, m.as_py(), probability_jaccard(held, one)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind)
                 for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


def _with_roots(df: DataFrame, column: str, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df.withColumn("root", F.col(column))
    known = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return (
        df.join(known, F.col(column) == F.col("__n"), "left")
        .withColumn("root", F.coalesce("__r", F.col(column))).drop("__n", "__r")
    )


def linked_nodes(
    sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, size: int,
    registers: int,
) -> DataFrame | None:
    """(node, root) of the texts linked to another one; None without any link.

    ``sketches`` has a row (node, keys, nibbles) per distinct text, ``fetch`` adds the text to
    the nodes that share a bucket with another one. In rounds, every bucket compares its
    first members ("heads") with all its other members that are not yet in the head's component;
    then the heads leave the bucket, since all their candidates there are decided. A bucket ends
    when one component is left in it. So every pair of a bucket is either decided or already
    linked, without a cap. Heads go by crowd: the text that a crowd of near copies was made
    from meets the most texts and resembles them all, so a crowd ends after one round, in
    time linear in its size. Heads per bucket grow fourfold per round.

    From the second round on a pair of a bucket is verified unless that is known to be vain: if it
    meets in an earlier band too (it is verified there), if the signatures differ in more registers
    than a pair at the threshold does plus 3.5 standard errors, or if the two differ by
    more than 1 - threshold in their exact similarity to the same head of the first round
    (1 - probability Jaccard is a metric).
    """
    entries = sketches.select("node", F.explode("keys").alias("bucket"))
    shared = (
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    sized = materialize(entries.join(shared, "bucket"), "pmh-entries")
    crowds = sized.groupBy("node").agg(F.sum("n").alias("crowd"))
    active = materialize(
        sized.select("bucket", "node").join(crowds, "node").select("bucket", "node", "crowd"),
        "pmh-crowds",
    )
    held = materialize(fetch(active.select("node").distinct()), "pmh-texts")
    roots, details, n_heads = None, None, 1
    while True:
        rooted = _with_roots(active, "node", roots)
        live = (
            rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo <> hi").select("bucket")
        )
        rooted = materialize(rooted.join(live, "bucket", "left_semi"), "pmh-live")
        if rooted.isEmpty():
            return roots
        order = Window.partitionBy("bucket").orderBy(F.desc("crowd"), "node")
        heads = materialize(
            rooted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_heads)
            .drop("r"),
            "pmh-heads",
        )
        later = (
            (F.col("root") != F.col("h_root"))
            & ((F.col("crowd") < F.col("h_crowd"))
               | ((F.col("crowd") == F.col("h_crowd")) & (F.col("node") > F.col("h_node"))))
        )
        left, right = rooted, heads
        if details is not None:
            left, right = left.join(details, "node"), right.join(details, "node")
            later = later & _worth(registers, threshold)
        pairs = left.join(
            right.select("bucket", *[F.col(c).alias(f"h_{c}") for c in right.columns if c != "bucket"]),
            "bucket",
        ).where(later).select(
            F.col("h_node").alias("head"), F.col("node").alias("member"),
            F.col("h_crowd").alias("head_crowd"),
        ).distinct()
        pairs = materialize(pairs, "pmh-pairs")
        seen = materialize(_verified(pairs, held, size), "pmh-verified")
        if details is None:
            details = _details(sketches, pairs, seen)
        roots = _merged(roots, seen.where(F.col("similarity") >= threshold - 1e-9).select("a", "b"))
        active = rooted.drop("root").join(
            heads.select("bucket", "node"), ["bucket", "node"], "left_anti"
        )
        n_heads = min(n_heads * 4, MAX_HEADS)


def _details(sketches: DataFrame, pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, keys, nibbles, anchor, near): signatures, and the similarity to the anchor, which
    is the largest head that the node was compared with. NULL for nodes that were heads only."""
    best = F.max(F.struct("head_crowd", F.col("a").alias("anchor"), F.col("similarity").alias("near")))
    anchors = (
        seen.join(pairs.select(F.col("head").alias("a"), F.col("member").alias("b"), "head_crowd"),
                  ["a", "b"])
        .groupBy(F.col("b").alias("node")).agg(best.alias("best"))
        .select("node", "best.anchor", "best.near")
    )
    return materialize(
        sketches.join(anchors, "node", "left").select("node", "keys", "nibbles", "anchor", "near"),
        "pmh-details",
    )


def _worth(registers: int, threshold: float) -> Column:
    """Whether a pair (head, member) of a bucket may reach the threshold and meets here first."""
    few = mismatches(F.col("nibbles"), F.col("h_nibbles"), -(-registers // 16)) <= (
        most_mismatches(registers, threshold)
    )
    apart = (F.col("anchor") == F.col("h_anchor")) & (
        F.abs(F.col("near") - F.col("h_near")) > 1 - threshold + 1e-9
    )
    earlier = F.array_position("keys", F.col("bucket")).cast("int") - 1
    met = F.arrays_overlap(F.slice("keys", F.lit(1), earlier), F.slice("h_keys", F.lit(1), earlier))
    return ~F.coalesce(apart, F.lit(False)) & few & ~met


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after adding ``links`` (a, b) between nodes."""
    if links.isEmpty():
        return roots
    if roots is None:
        return component_roots(links)
    joined = _with_roots(_with_roots(links, "a", roots).drop("a").withColumnRenamed("root", "a"),
                         "b", roots).drop("b").withColumnRenamed("root", "b")
    higher = component_roots(joined.where("a <> b"))
    moved = higher.select(F.col("node").alias("root"), F.col("root").alias("__top"))
    old = (
        roots.join(moved, "root", "left")
        .select("node", F.coalesce("__top", "root").alias("root"))
    )
    # Nodes that had no component before are in ``higher`` only.
    new = higher.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return materialize(old.unionByName(new), "pmh-roots")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 32, rows: int = 6,
    digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept (and digest, if wanted).

    A class is a connected component of equal texts and of texts whose shingles of ``size``
    words (weights 1 + ln(count)) have a probability Jaccard of ``threshold`` or more.
    Equal texts are folded first, by a digest. ProbMinHash signatures of ``bands`` x ``rows``
    registers give candidates (a pair at 0.8 is missed with a probability of 3 in 10,000, one at
    0.85 with 2 in a million), which are verified on whole texts; see ``linked_nodes``. ``class_id`` is the smallest doc_id of the class;
    ``kept`` marks one row per class, that of the smallest doc_id (of repeated rows with that
    id any one; their other columns decide nothing).

    NULL texts, and texts without words, resemble nothing: each such row is a class of its own,
    named by its doc_id. So is a row with a NULL doc_id (class NULL): it is kept and links
    nothing. A text of fewer than ``size`` words is one shingle. An empty table gives no rows.
    """
    text = whole_text()
    usable = F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows_in = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.when(usable, F.unhex(F.md5("text"))).alias("digest")
    )
    with_words = rows_in.where(usable)
    members = materialize(rows_in.select("doc_id", "digest"), "pmh-members")
    firsts = members.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("doc_id")
    )
    # Sketches are made where the texts are read: keys are shuffled, texts are not.
    sketches = materialize(_sketch(with_words, size, bands, rows), "pmh-sketches")
    nodes = materialize(
        sketches.join(firsts, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
        .withColumn("node", F.monotonically_increasing_id()),
        "pmh-nodes",
    )

    def fetch(wanted: DataFrame) -> DataFrame:
        names = nodes.select("digest", "doc_id", "node").join(wanted, "node", "left_semi")
        return (
            with_words.join(names, ["digest", "doc_id"]).select("node", "text")
            .dropDuplicates(["node"])
        )

    roots = linked_nodes(
        nodes.select("node", "keys", "nibbles"), fetch, threshold, size, bands * rows
    )
    rooted = _with_roots(nodes.select("digest", "doc_id", "node"), "node", roots)
    named = rooted.join(
        rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root"
    ).select("digest", "class_id", "root")
    return _labelled(members, materialize(named, "pmh-classes"), ["digest"] if digests else [])


def _labelled(members: DataFrame, named: DataFrame, more: list[str]) -> DataFrame:
    """Class, size and the kept row. Equal texts of a crowd are counted before the join.

    Classes are told apart by ``root``: two of them have one name if unlike rows share an id.
    """
    found = materialize(
        salted_join(members, named, ["digest"], ["doc_id"], "left")
        .select("doc_id", *more, F.coalesce("class_id", "doc_id").alias("class_id"),
                # A row without words is alone, whatever the number of such rows.
                F.coalesce("root", -1 - F.monotonically_increasing_id()).alias("root"),
                F.col("digest").isNotNull().alias("grouped"),
                F.monotonically_increasing_id().alias("row")),
        "pmh-labelled",
    )
    sizes = found.where("grouped").groupBy("root").agg(
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.when(F.col("doc_id") == F.col("class_id"), F.col("row"))).alias("first"),
    )
    return salted_join(found, sizes, ["root"], ["row"], "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (~F.col("grouped") | (F.col("row") == F.col("first"))).alias("kept"), *more,
    )


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all columns.

    Several rows of one doc_id are told apart by the digest of the text, only where some of them
    go. Of rows equal in id and text at most one stays, whichever.
    """
    clean = without(docs, [])
    kept = materialize(
        near_duplicates(clean, **parameters, digests=True).where("kept")
        .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("__n")),
        "pmh-kept",
    )
    per_id = kept.groupBy("doc_id").agg(F.sum("__n").alias("__kept"))
    ids = clean.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"))
    # Only the ids that lose a row: fewer than those that stay, so the texts may stay in place.
    losing = materialize(
        ids.join(per_id, "doc_id", "left").where("coalesce(__kept, 0) < __rows")
        .select("doc_id", "__kept"),
        "pmh-losing",
    )
    simple = clean.join(losing.select("doc_id"), "doc_id", "left_anti").select(*clean.columns)
    several = losing.where("__kept > 0")
    if several.isEmpty():
        return simple
    # Texts without words have no digest and resemble nothing: all of them stay.
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = clean.join(several.select("doc_id"), "doc_id").withColumn(
        "__digest", F.when(has_words, F.unhex(F.md5(whole_text())))
    )
    pairs = kept.where("digest IS NOT NULL").select("doc_id", F.col("digest").alias("__digest"))
    chosen = rest.join(pairs, ["doc_id", "__digest"], "left_semi").dropDuplicates(
        ["doc_id", "__digest"]
    )
    return simple.unionByName(chosen.select(*clean.columns)).unionByName(
        rest.where("__digest IS NULL").select(*clean.columns)
    )
