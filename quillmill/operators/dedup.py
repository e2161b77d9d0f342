"""Near-duplicate removal inside strata: keep the first, drop what resembles a kept row.

Two texts are near-duplicates if the Jaccard similarity of their word sets reaches the
threshold. Rows are taken in id order and tested against kept rows only, so of a chain
A~B~C with A not similar to C both A and C stay.

Candidates come from one of two blockings, and every candidate is verified:

* ``parts`` loses nothing. Similar sets differ in at most H words, H following from their
  sizes; hash the words of a set into more than H parts and one part must be equal. Equal
  parts hold about six words, which makes blocks far more selective than single words.
* ``minhash`` joins on bands of a MinHash signature and may miss pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import fixed
from quillmill.functions.draws import number
from quillmill.functions.text import token_set
from quillmill.operators import blocking
from quillmill.operators.graph import component_roots
from quillmill.operators.scale import null_safe_key, salted_join
from quillmill.session import materialize

BLOCK = ["block"]
#: Heads of a first round: each near-copy of a head moves that head's word set once.
HEADS = 2
HEADS_GROWTH = 4
PRIME = 4_294_967_311  # smallest prime above 2^32
CELLS = 1 << 20
#: Words per long of a sketch, before its length is rounded up to a power of two.
SKETCHED = 64


# --- word sets ----------------------------------------------------------------------


def token_sets(df: DataFrame, id_col: str, stratum: str, text_col: str) -> DataFrame:
    """(id, stratum, tokens, set_key); equal word sets have equal keys."""
    return df.select(
        F.col(id_col).alias("id"),
        F.col(stratum).alias("stratum"),
        token_set(F.col(text_col)).alias("tokens"),
    ).withColumn("set_key", F.md5(F.array_join("tokens", " ")))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


# --- blocks: equal parts --------------------------------------------------------------


def size_groups(threshold: float, largest: int) -> list[tuple[int, int]]:
    """(smallest size, most differing words) per size group, up to sets of ``largest`` words.

    A group ends where its smallest set no longer reaches the threshold with a larger
    one, so similar sets lie in the same or in neighbouring groups.
    """
    if threshold >= 1:
        return [(1, 0)]  # only equal sets are similar, and those are folded beforehand
    groups, low = [], 1
    while low <= largest:
        high = max(low, math.floor(low / threshold + 1e-9))
        groups.append((low, math.floor(high * (1 - threshold) / threshold + 1e-6)))
        low = high + 1
    return groups


def part_blocks(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, size, block): blocks in which every similar pair meets.

    A row is cut into parts once for its own size group and once for the group below
    (where its smaller partner may be). H differing words leave slack + 1 equal parts among
    H + 1 + slack, and a row drops its ``slack`` weakest parts: those of the fewest characters,
    ties by content. That order is the same for every row, so the strongest part that two rows
    share is dropped by neither. Weak parts hold few and short words, which are frequent:
    unlike rows would meet in their blocks, and more the more rows there are. A row
    with more empty parts than it drops also blocks on its first words in hash order, as does
    any partner that could share only empty parts with it; similar sets share one of those.
    The groups end with the largest set, which is looked up first: ``sets`` should be stored.
    Blocks follow from a row alone, so nothing is shuffled for them.
    """
    largest = sets.agg(F.max(F.size("tokens"))).first()[0]
    groups = size_groups(threshold, max(1, largest or 1))
    lows = np.array([low for low, _ in groups])
    differ = np.array([most for _, most in groups])
    schema = T.StructType([
        sets.schema["id"], T.StructField("size", T.IntegerType()),
        T.StructField("block", T.LongType()),
    ])

    def mixed(x: np.ndarray) -> np.ndarray:
        """64 bits that depend on all bits of x, one to one."""
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def of_group(hashes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, scopes: np.ndarray,
                 group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the rows in their size group ``group``, if there is such a group."""
        most = np.where(group >= 1, differ[np.maximum(group, 1) - 1], 0)
        slack = 1 + most // 10
        parts = np.where(most > 0, most + 1 + slack, 0)
        ends = np.cumsum(parts)
        used = parts > 0
        row = np.repeat(np.arange(len(sizes)), np.where(used, sizes, 0))
        mine = hashes[np.repeat(used, sizes)]
        at = (ends - parts)[row] + mine % parts[row]
        content = np.zeros(parts.sum(), np.int64)
        np.bitwise_xor.at(content, at, mine)
        whose = np.repeat(np.arange(len(sizes)), parts)
        words = np.bincount(at, minlength=len(content))
        strength = np.bincount(at, lengths[np.repeat(used, sizes)], len(content))
        place = np.arange(len(content)) - (ends - parts)[whose]
        order = np.lexsort((place, content, strength, words > 0, whose))
        stays = np.empty(len(content), bool)
        stays[order] = place >= slack[whose]  # rows keep their places in that order
        filled = np.flatnonzero(stays & (words > 0))
        owner = whose[filled]
        base = mixed(mixed(scopes) + group.astype(np.uint64))
        by_part = mixed(mixed(base[owner] + (place[filled] + 1).astype(np.uint64))
                        ^ content[filled].view(np.uint64))
        short = used & (np.bincount(owner, minlength=len(sizes)) < parts - slack)
        which = np.repeat(short, sizes)
        row, mine = np.repeat(np.arange(len(sizes)), sizes)[which], hashes[which]
        order = np.lexsort((mine, row))
        row, mine = row[order], mine[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < (sizes - np.ceil(sizes * threshold - 1e-6).astype(np.int64) + 1)[row]
        by_first = mixed(mixed(base[row[first]]) ^ mine[first].view(np.uint64))
        return np.r_[owner, row[first]], np.r_[by_part, by_first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                hashes = batch.column("hashes").flatten().to_numpy()
                lengths = batch.column("lengths").flatten().to_numpy()
                sizes = pc.list_value_length(batch.column("hashes")).to_numpy().astype(np.int64)
                scopes = batch.column("scope").to_numpy().view(np.uint64)
                own = np.searchsorted(lows, sizes, "right")
                for group in (own, own - 1):
                    row, block = of_group(hashes, lengths, sizes, scopes, group)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row)), pa.array(sizes[row], pa.int32()),
                         pa.array(block.view(np.int64))], names=schema.names)

    hashed = sets.where(F.size("tokens") > 0).select(
        "id", F.xxhash64("stratum").alias("scope"),
        F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"),
        F.transform("tokens", lambda t: F.length(t)).alias("lengths"))
    return hashed.mapInArrow(run, schema)


# --- blocks: MinHash ------------------------------------------------------------------


def minhash_signatures(
    sets: DataFrame, num_perm: int = fixed.NUM_PERMUTATIONS, seed: int = fixed.SEED
) -> DataFrame:
    """(id, stratum, size, signature): per permutation the least (a * h + b) mod PRIME.

    h is the word's 32-bit draw; a < 2^30 keeps a * h + b inside 64 bits. A signature follows
    from its row alone, so nothing is shuffled: Arrow batches go through numpy, ``CELLS``
    numbers at a time, and each word is hashed once a batch. (As an aggregate per permutation
    this is too wide for generated code.) Rows without words have no signature.
    """
    slopes = np.array([number(seed, "slope", i) % 2**30 + 1 for i in range(num_perm)], np.int64)
    shifts = np.array([number(seed, "shift", i) for i in range(num_perm)], np.int64)
    schema = T.StructType([
        sets.schema["id"], sets.schema["stratum"], T.StructField("size", T.IntegerType()),
        T.StructField("signature", T.ArrayType(T.LongType())),
    ])
    step = max(1, CELLS // num_perm)

    def least(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.full((len(starts), num_perm), PRIME, np.int64)
        for at in range(0, len(hashes), step):
            part = (hashes[at:at + step, None] * slopes + shifts) % PRIME
            row = np.searchsorted(starts, at, "right") - 1  # the row that the part begins in
            inside = starts[row + 1:np.searchsorted(starts, at + step)] - at
            low = np.minimum.reduceat(part, np.r_[0, inside].astype(int))
            out[row:row + len(low)] = np.minimum(out[row:row + len(low)], low)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                batch = batch.filter(pc.greater(pc.list_value_length(batch.column("tokens")), 0))
                if not batch.num_rows:
                    continue
                words = batch.column("tokens").flatten().dictionary_encode()
                known = np.array([
                    int(hashlib.md5(f"{seed}|word|{w}".encode()).hexdigest()[:8], 16)
                    for w in words.dictionary.to_pylist()], np.int64)
                sizes = pc.list_value_length(batch.column("tokens")).to_numpy()
                starts = np.cumsum(sizes) - sizes
                values = least(known[words.indices.to_numpy()], starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("stratum"), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(sizes) + 1) * num_perm, pa.int32()),
                         pa.array(values.ravel()))],
                    names=schema.names)

    return sets.select("id", "stratum", "tokens").mapInArrow(run, schema)


def band_blocks(signed: DataFrame, bands: int = 20, rows: int = 6) -> DataFrame:
    """(id, size, block): one block per stratum and band of the signature."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64("stratum", i, F.slice("signature", i * rows + 1, rows)),
    )
    return signed.select("id", "size", F.explode(keys).alias("block"))


def first_candidates(entries: DataFrame) -> DataFrame:
    """(id, candidate): the smallest earlier id that shares a block, for rows with one.

    A minimum per block instead of the pairs of the block.
    """
    lowest = entries.groupBy(*BLOCK).agg(F.min("id").alias("candidate"))
    return (
        salted_join(entries, lowest, BLOCK, ["id"])
        .where(F.col("candidate") < F.col("id"))
        .groupBy("id")
        .agg(F.min("candidate").alias("candidate"))
    )


# --- keep first -----------------------------------------------------------------------


def _size_fits(threshold: float) -> Column:
    small, large = F.least("size", "h_size"), F.greatest("size", "h_size")
    return small >= large * threshold - 1e-6


def word_sets(sets: DataFrame) -> DataFrame:
    return sets.select("id", F.struct("stratum", "tokens").alias("value"))


def sketches(payload: DataFrame) -> DataFrame:
    """(id, words, sketch): the parity of the words that fall on each bit, of (id, value).

    Two sketches differ in no more bits than the sets do in words. Lengths are powers of two,
    about a bit per word or two, and a longer sketch folds into one of half its length.
    """
    schema = T.StructType([
        payload.schema["id"], T.StructField("words", T.IntegerType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                hashes = batch.column("hashes").flatten().to_numpy().view(np.uint64)
                sizes = pc.fill_null(pc.list_value_length(batch.column("hashes")), 0).to_numpy()
                longs = 2 ** np.ceil(np.log2(np.maximum(sizes / SKETCHED, 1))).astype(np.int64)
                ends = np.cumsum(longs)
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = (hashes >> np.uint64(6)).astype(np.int64) & (longs[row] - 1)
                bits = np.zeros(longs.sum(), np.uint64)
                np.bitwise_xor.at(
                    bits, (ends - longs)[row] + at, np.uint64(1) << (hashes & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(
                         pa.array(np.r_[0, ends], pa.int32()), pa.array(bits.view(np.int64)))],
                    names=schema.names)

    hashed = payload.select("id", F.transform("value.tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    return materialize(hashed.mapInArrow(run, schema), "sketches")


def _may_be_similar(threshold: float) -> Column:
    """False only where the sketches show that the sets differ in too many words."""
    length = F.least(F.size("a_sketch"), F.size("b_sketch"))

    def folded(sketch: str) -> Column:
        halves = F.zip_with(
            F.slice(sketch, F.lit(1), length), F.slice(sketch, length + 1, length),
            lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sketch) > length, halves).otherwise(F.col(sketch))

    differ = F.aggregate(
        F.zip_with(folded("a_sketch"), folded("b_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda total, x: total + x)
    most = (F.col("a_words") + F.col("b_words")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    far = F.greatest(F.size("a_sketch"), F.size("b_sketch")) > 2 * length
    return far | (differ <= most)


def screened(pairs: DataFrame, heads: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The (head, member) that may be similar by their ``sketches``; no similar pair is lost.

    Blocks also hold pairs that share a few frequent words; those go before a word set moves.
    """
    a, b = (
        side.select(F.col("id").alias(name), F.col("words").alias(f"{short}_words"),
                    F.col("sketch").alias(f"{short}_sketch"))
        for side, name, short in ((heads, "head", "a"), (members, "member", "b")))
    both = salted_join(pairs, a, ["head"], ["member"]).join(b, "member")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(
        both.where(_may_be_similar(threshold)).select("head", "member").repartition(tasks, "member"),
        "screened")


def _verified(pairs: DataFrame, payload: DataFrame, threshold: float) -> DataFrame:
    """(head, member, similarity) of the pairs that are similar; blocks are only hashes."""
    return _similar(blocking.with_payload(pairs, payload, "value"), threshold)


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    return (
        pairs.where(F.col("a.stratum").eqNullSafe(F.col("b.stratum")))
        .withColumn("similarity", jaccard(F.col("a.tokens"), F.col("b.tokens")))
        .where(F.col("similarity") >= threshold)
        .select("head", "member", "similarity")
    )


def drop_similar(
    entries: DataFrame, sets: DataFrame, threshold: float, per_block: int = HEADS
) -> list[DataFrame]:
    """Ids that lose against a kept row, one frame per round.

    Invariant: an undecided row has no kept earlier neighbour. A row that is a head in all
    of its blocks has been compared with every earlier undecided row; if none of them is
    similar it is kept, and its similar later rows, all compared with it, are dropped.
    The smallest undecided id is always decided, so the loop ends.
    """
    active = materialize(blocking.without_singletons(entries, BLOCK), "blocks")
    payload = word_sets(sets)
    drawn = sketches(payload)
    dropped: list[DataFrame] = []
    while not active.isEmpty():
        leaders = blocking.heads(active, BLOCK, per_block)
        pairs = blocking.head_pairs(
            active, leaders, BLOCK, (F.col("h_id") < F.col("id")) & _size_fits(threshold)
        )
        similar = materialize(
            _verified(screened(pairs, drawn, drawn, threshold), payload, threshold)
            .select("head", "member"),
            "similar",
        )
        everywhere = (
            active.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"))
            .join(leaders.groupBy("id").agg(F.count(F.lit(1)).alias("led")), "id")
            .where(F.col("blocks") == F.col("led"))
            .select("id")
        )
        blocked = similar.select(F.col("member").alias("id"))
        kept = everywhere.join(blocked, "id", "left_anti")
        lost = (
            salted_join(similar, kept.withColumnRenamed("id", "head"), ["head"], ["member"])
            .select(F.col("member").alias("id"))
            .distinct()
        )
        decided = materialize(
            kept.withColumn("lost", F.lit(False)).unionByName(
                lost.withColumn("lost", F.lit(True))
            ),
            "decided",
        )
        dropped.append(decided.where("lost").select("id"))
        active = materialize(
            blocking.without_singletons(active.join(decided, "id", "left_anti"), BLOCK).select(
                active.columns
            ),
            "blocks",
        )
        per_block = min(per_block * HEADS_GROWTH, blocking.MAX_HEADS)
    return dropped


def kept_ids(
    df: DataFrame,
    id_col: str,
    stratum: str,
    text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
    blocks: Callable[[DataFrame], DataFrame] | None = None,
    per_block: int = HEADS,
) -> DataFrame:
    """Ids (column ``id_col``) of the rows that stay.

    Equal word sets are folded first, with a minimum per set: a crowd of copies never
    reaches the blocks. ``blocks`` turns word sets into (id, size, block) and
    defaults to the lossless parts.
    """
    keyed = token_sets(df, id_col, stratum, text_col)
    firsts = materialize(
        keyed.groupBy("stratum", "set_key").agg(F.min("id").alias("id")).select("id"), "firsts"
    )
    sets = materialize(keyed.drop("set_key").join(firsts, "id", "left_semi"), "sets")
    make = blocks or (lambda s: part_blocks(s, threshold))
    rounds = drop_similar(make(sets), sets, threshold, per_block)
    kept = firsts.join(reduce(DataFrame.unionByName, rounds), "id", "left_anti") if rounds else firsts
    return kept.withColumnRenamed("id", id_col)


def deduplicate(
    df: DataFrame,
    id_col: str,
    stratum: str,
    text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
    blocks: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows of ``df`` that are not near-duplicates of an earlier kept row."""
    kept = kept_ids(df, id_col, stratum, text_col, threshold, blocks)
    return df.join(kept, id_col, "left_semi")


def flag_duplicates(
    df: DataFrame,
    id_col: str,
    stratum: str,
    text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
    blocks: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, stratum, kept) for every row."""
    kept = kept_ids(df, id_col, stratum, text_col, threshold, blocks)
    return df.select(id_col, stratum).join(
        kept.withColumn("kept", F.lit(True)), id_col, "left"
    ).withColumn("kept", F.coalesce("kept", F.lit(False)))


def links_to_kept(
    entries: DataFrame, payload: DataFrame, kept_entries: DataFrame, kept_payload: DataFrame,
    threshold: float, earlier: bool = False, per_block: int = HEADS,
) -> DataFrame:
    """(member, head, similarity): the kept row of smallest id that each row resembles.

    ``entries`` and ``kept_entries`` are (id, size, block), the payloads (id, value). In rounds,
    rows are compared with the next kept rows of their blocks, in id order. A row leaves a
    block once it resembles a kept row no later than those, so a crowd of near-copies is
    compared with few heads however many a block has. ``earlier`` only admits kept rows of
    smaller id; otherwise the two tables may use the same ids for different rows.
    """
    active = materialize(
        entries.join(kept_entries.select("block").distinct(), BLOCK, "left_semi")
        .select("id", "size", "block"), "link-rows")
    standing = materialize(
        kept_entries.join(active.select("block").distinct(), BLOCK, "left_semi")
        .select("id", "size", "block"), "link-heads")
    sketched, kept_sketched = sketches(payload), sketches(kept_payload)
    order = (F.col("h_id") < F.col("id")) if earlier else F.lit(True)
    found: list[DataFrame] = []
    while not standing.isEmpty():
        leaders = materialize(blocking.heads(standing, BLOCK, per_block), "leaders")
        pairs = blocking.head_pairs(active, leaders, BLOCK, order & _size_fits(threshold))
        both = blocking.with_payload(
            screened(pairs, kept_sketched, sketched, threshold), kept_payload, "value", payload)
        found.append(materialize(_similar(both, threshold), "linked"))
        best = _earliest(found)
        turn = leaders.groupBy("block").agg(F.max("id").alias("_upto"))
        left = active.join(best.select(F.col("member").alias("id"), "head"), "id", "left").join(
            turn, BLOCK, "left")
        active = materialize(
            left.where(F.coalesce(F.col("head") > F.col("_upto"), F.lit(True)))
            .select("id", "size", "block"), "link-rows")
        standing = materialize(
            standing.join(leaders.select("block", "id"), ["block", "id"], "left_anti")
            .join(active.select("block").distinct(), BLOCK, "left_semi")
            .select("id", "size", "block"), "link-heads")
        per_block = min(per_block * HEADS_GROWTH, blocking.MAX_HEADS)
    if not found:
        kind = kept_entries.schema["id"].dataType.simpleString()
        return active.limit(0).select(
            F.col("id").alias("member"), F.lit(None).cast(kind).alias("head"),
            F.lit(None).cast("double").alias("similarity"))
    return _earliest(found)


def _earliest(found: list[DataFrame]) -> DataFrame:
    return (
        reduce(DataFrame.unionByName, found).groupBy("member")
        .agg(F.min(F.struct("head", "similarity")).alias("link")).select("member", "link.*")
    )


def similar_components(
    df: DataFrame, id_col: str, stratum: str, text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD, per_block: int = HEADS,
) -> DataFrame:
    """(id, component): rows linked by a chain of near-duplicates; named by the smallest id.

    Unlike the links to kept rows this joins A and C of a chain A~B~C. Rows are compared
    with the heads of their blocks, in rounds, unless one component holds both already; a
    block of one component is closed, so a crowd closes after few heads.
    """
    keyed = token_sets(df, id_col, stratum, text_col)
    keys = materialize(keyed.select("id", "stratum", "set_key"), "set-keys")
    firsts = materialize(
        keys.groupBy("stratum", "set_key").agg(F.min("id").alias("first")), "firsts")
    sets = materialize(
        keyed.drop("set_key").join(firsts.select(F.col("first").alias("id")), "id", "left_semi"), "sets")
    active = materialize(
        blocking.without_singletons(part_blocks(sets, threshold), BLOCK)
        .select("id", "size", "block", F.col("id").alias("root")), "blocks")
    payload = word_sets(sets)
    drawn = sketches(payload)
    roots = materialize(sets.select("id", F.col("id").alias("root")), "roots")
    while not active.isEmpty():
        leaders = materialize(blocking.heads(active, BLOCK, per_block), "heads")
        pairs = blocking.head_pairs(
            active, leaders, BLOCK, (F.col("h_root") != F.col("root")) & _size_fits(threshold))
        near = _verified(screened(pairs, drawn, drawn, threshold), payload, threshold)
        links = materialize(
            near.join(roots.select(F.col("id").alias("head"), F.col("root").alias("a")), "head")
            .join(roots.select(F.col("id").alias("member"), F.col("root").alias("b")), "member")
            .select("a", "b").distinct(), "links")
        if not links.isEmpty():
            moved = component_roots(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
            roots = materialize(
                salted_join(roots, moved, ["root"], ["id"], "left")
                .select("id", F.coalesce("to", "root").alias("root")), "roots")
        left = materialize(
            active.drop("root").join(leaders.select("block", "id"), ["block", "id"], "left_anti")
            .join(roots, "id"), "blocks")
        # What is left of a block is open while it holds two components, or one unlike its heads.
        heads_of = leaders.select("block", "id").join(roots, "id").select("block", "root")
        many = left.select("block", "root").unionByName(heads_of).groupBy("block").agg(
            F.count_distinct("root").alias("n")).where(F.col("n") > 1).select("block")
        active = materialize(
            blocking.without_singletons(left.join(many, BLOCK, "left_semi"), BLOCK)
            .select("id", "size", "block", "root"), "blocks")
        per_block = min(per_block * HEADS_GROWTH, blocking.MAX_HEADS)
    named = materialize(
        firsts.join(roots.withColumnRenamed("id", "first"), "first")
        .withColumn("_code", null_safe_key("stratum")).select("_code", "set_key", "root"), "named")
    return salted_join(
        materialize(keys.withColumn("_code", null_safe_key("stratum")).drop("stratum"), "keys"),
        named, ["_code", "set_key"], ["id"],
    ).select(F.col("id").alias(id_col), F.col("root").alias("component"))


def duplicate_links(
    df: DataFrame,
    id_col: str,
    stratum: str,
    text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
) -> DataFrame:
    """(id, kept_id, similarity): every dropped row with the earliest kept row it resembles.

    Linear in the dropped rows, where a list of all similar pairs would be quadratic in
    the size of a group of near-copies.
    """
    keyed = token_sets(df, id_col, stratum, text_col)
    keys = materialize(keyed.drop("tokens"), "set-keys")
    firsts = materialize(
        keys.groupBy("stratum", "set_key").agg(F.min("id").alias("first")), "firsts"
    )
    sets = materialize(
        keyed.drop("set_key").join(
            firsts.select(F.col("first").alias("id")), "id", "left_semi"
        ),
        "sets",
    )
    entries = materialize(
        blocking.without_singletons(part_blocks(sets, threshold), BLOCK), "blocks"
    )
    payload = word_sets(sets)
    rounds = drop_similar(entries, sets, threshold, HEADS)
    lost = reduce(DataFrame.unionByName, rounds) if rounds else payload.select("id").limit(0)
    near = links_to_kept(
        entries.join(lost, "id", "left_semi"), payload,
        entries.join(lost, "id", "left_anti"), payload, threshold, earlier=True,
    ).select(F.col("member").alias("first"), "head", "similarity")
    # A copy resembles what its first copy resembles; failing that, the first copy itself.
    answers = firsts.join(near, "first", "left").withColumn("_code", null_safe_key("stratum"))
    copies = salted_join(
        keys.withColumn("_code", null_safe_key("stratum")).drop("stratum"),
        answers.drop("stratum"), ["_code", "set_key"], ["id"],
    )
    return copies.where(F.col("head").isNotNull() | (F.col("id") != F.col("first"))).select(
        F.col("id").alias(id_col),
        F.coalesce("head", "first").alias("kept_id"),
        F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
    )


def dedup_report(flags: DataFrame, stratum: str) -> DataFrame:
    """Removed and kept rows per stratum and, with ``total`` = 1, overall."""
    return flags.groupingSets([[stratum], []], stratum).agg(
        F.grouping(stratum).cast("bigint").alias("total"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("removed"),
    )
