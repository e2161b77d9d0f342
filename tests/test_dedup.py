"""Near-duplicates against a plain greedy pass."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import blocking, dedup
from quillmill.session import materialize

SCHEMA = "id bigint, stratum string, text string"


def greedy(rows, threshold):
    kept = {}
    for i, stratum, text in sorted(rows):
        mine = set(text.lower().split())
        for _, other in kept.get(stratum, []):
            union = len(mine | other)
            if union == 0 or len(mine & other) / union >= threshold:
                break
        else:
            kept.setdefault(stratum, []).append((i, mine))
    return sorted(i for rows in kept.values() for i, _ in rows)


def kept(spark, rows, threshold=0.85, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(
        r.id for r in dedup.kept_ids(df, "id", "stratum", "text", threshold, **more).collect()
    )


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def test_near_copy_within_a_class_is_dropped(spark):
    base = " ".join(words("word", 80))
    rows = [(0, "a", base), (1, "a", base + " extra"), (2, "a", " ".join(words("other", 80)))]
    assert kept(spark, rows) == [0, 2]


def test_same_text_under_other_classes_stays(spark):
    base = " ".join(words("word", 80))
    assert kept(spark, [(i, f"class {i}", base) for i in range(3)]) == [0, 1, 2]


def test_chain_is_tested_against_kept_rows_only(spark):
    def text(drop, extra):
        return " ".join(words("w", 100)[drop:] + words("x", extra))

    rows = [(0, "a", text(0, 0)), (1, "a", text(8, 8)), (2, "a", text(16, 16))]
    assert greedy(rows, 0.85) == [0, 2]
    assert kept(spark, rows) == [0, 2]


def mutated(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return " ".join(out)


def random_rows(seed):
    """Strata of mutated copies, sizes 1 to 120 words, ids in random order."""
    rng = random.Random(seed)
    rows = []
    for s in range(24):
        size = rng.choice([1, 2, 5, 6, 7, 9, 13, 20, 33, 60, 120])
        bases = [[f"b{s}_{k}_{i}" for i in range(size)] for k in range(3)]
        for _ in range(14):
            text = mutated(rng, rng.choice(bases), rng.randrange(0, max(2, size // 5)))
            if rng.random() < 0.3:
                text += " " + " ".join(words(f"e{rng.randrange(3)}_", rng.randrange(1, 4)))
            rows.append((f"s{s}", text))
    rows.append(("empty", ""))
    rows.append(("empty", "  "))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, s, t) for i, (s, t) in zip(ids, rows)]


@pytest.mark.parametrize("threshold, per_block", [(0.85, 64), (0.85, 1), (0.6, 2), (1.0, 64)])
def test_parts_equal_the_greedy_pass(spark, threshold, per_block):
    rows = random_rows(int(threshold * 100) + per_block)
    assert kept(spark, rows, threshold, per_block=per_block) == greedy(rows, threshold)


def test_every_similar_pair_shares_a_block(spark):
    rows = random_rows(3)
    for threshold in (0.7, 0.85):
        sets = dedup.token_sets(spark.createDataFrame(rows, SCHEMA), "id", "stratum", "text")
        blocks = {}
        for r in dedup.part_blocks(sets, threshold).collect():
            blocks.setdefault(r.id, set()).add(r.block)
        for i, s, a in rows:
            for j, s2, b in rows:
                x, y = set(a.split()), set(b.split())
                if i < j and s == s2 and x != y and x | y:
                    if len(x & y) / len(x | y) >= threshold:
                        assert blocks.get(i, set()) & blocks.get(j, set()), (a, b)


def test_minhash_blocks_find_close_copies(spark):
    base = words("w", 200)
    rows = [(i, "a", " ".join(base + [f"x{i}"])) for i in range(20)]
    rows += [(100 + i, "a", " ".join(words(f"u{i}_", 50))) for i in range(5)]
    got = kept(spark, rows, blocks=lambda s: dedup.band_blocks(dedup.minhash_signatures(s)))
    assert got == [0, 100, 101, 102, 103, 104]


def test_a_crowd_of_near_copies_lists_few_pairs(spark, monkeypatch):
    listed = []
    plain = blocking.head_pairs

    def counting(*args):
        pairs = plain(*args)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(blocking, "head_pairs", counting)
    n = 400
    base = words("w", 60)
    rows = [(i, "a", " ".join(base + [f"x{i}"])) for i in range(n)]
    assert kept(spark, rows, per_block=4) == [0]
    assert sum(listed) < 6 * n  # all pairs would be 200 per row


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(random_rows(9), SCHEMA)
    a, b = (
        sorted(r.id for r in dedup.kept_ids(df.repartition(n), "id", "stratum", "text").collect())
        for n in (1, 8)
    )
    assert a == b


def test_links_name_the_earliest_kept_row(spark):
    rows = random_rows(11)
    df = spark.createDataFrame(rows, SCHEMA)
    stay = set(greedy(rows, 0.85))
    text = {i: (s, set(t.split())) for i, s, t in rows}
    links = dedup.duplicate_links(df, "id", "stratum", "text").collect()
    assert sorted(r.id for r in links) == sorted(set(text) - stay)
    for r in links:
        s, mine = text[r.id]

        def near(i):
            union = mine | text[i][1]
            return text[i][0] == s and (
                not union or len(mine & text[i][1]) / len(union) >= 0.85
            )

        assert r.kept_id == min(i for i in stay if i < r.id and near(i))


def test_report_counts_rows(spark):
    base = " ".join(words("word", 80))
    df = spark.createDataFrame([(0, "a", base), (1, "a", base), (2, "b", base)], SCHEMA)
    flags = dedup.flag_duplicates(df, "id", "stratum", "text")
    got = {(r.stratum, r.total): (r.rows, r.kept, r.removed)
           for r in dedup.dedup_report(flags, "stratum").collect()}
    assert got == {("a", 0): (2, 1, 1), ("b", 0): (1, 1, 0), (None, 1): (3, 2, 1)}


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.85])
def test_the_screen_loses_no_similar_pair(spark, threshold):
    rng = random.Random(5)
    rows = random_rows(5)
    for k in range(12):  # long sets, whose sketches differ in length
        base = words(f"l{k}_", rng.choice([60, 64, 66, 120, 130, 250, 260]))
        rows += [(1000 + 9 * k + j, "long", mutated(rng, base + words(f"x{k}{j}_", rng.randrange(9)), 3 * j))
                 for j in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).where(F.trim("text") != "")
    payload = dedup.word_sets(dedup.token_sets(df, "id", "stratum", "text"))
    text = {i: (s, set(t.split())) for i, s, t in rows if t.strip()}
    every = [(i, j) for i in text for j in text if i < j and text[i][0] == text[j][0]]
    drawn = dedup.sketches(payload)
    left = {tuple(r) for r in dedup.screened(
        spark.createDataFrame(every, "head bigint, member bigint"), drawn, drawn, threshold).collect()}
    near = {(i, j) for i, j in every
            if len(text[i][1] & text[j][1]) / len(text[i][1] | text[j][1]) >= threshold}
    assert near <= left and near
    if threshold == 0.85:
        assert len(left) < 0.5 * len(every)


def test_unlike_rows_of_a_block_do_not_move_word_sets(spark, monkeypatch):
    """Rows that share one frequent word per part meet in blocks; few of them are verified."""
    verified = []
    inner = dedup._verified

    def counting(pairs, payload, threshold):
        verified.append(pairs.count())
        return inner(pairs, payload, threshold)

    monkeypatch.setattr(dedup, "_verified", counting)
    n = 60
    rows = [(i, "a", " ".join(words("shared", 20) + words(f"own{i}_", 40))) for i in range(n)]
    one_block = lambda sets: sets.select(
        "id", F.size("tokens").alias("size"), F.lit(7).cast("long").alias("block"))
    assert kept(spark, rows, blocks=one_block) == list(range(n))
    assert sum(verified) < n  # all pairs: 1,770


def test_blocks_are_made_without_a_shuffle_and_shuffled_once(spark):
    df = spark.createDataFrame(random_rows(3), SCHEMA)
    sets = materialize(dedup.token_sets(df, "id", "stratum", "text"), "sets")
    entries = dedup.part_blocks(sets, 0.85)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(entries)
    assert plan(blocking.without_singletons(entries, ["block"])).count("Exchange") == 1


def test_long_unlike_rows_with_frequent_words_seldom_meet(spark):
    rng = random.Random(8)
    rows = [(i, "a", " ".join(words("the", 110) + [f"u{i}_{k}" for k in range(rng.randrange(240, 280))]))
            for i in range(60)]
    rows.append((60, "a", " ".join(rows[0][2].split()[:-20] + words("new", 20))))
    sets = materialize(
        dedup.token_sets(spark.createDataFrame(rows, SCHEMA), "id", "stratum", "text"), "sets")
    met = {}
    for r in dedup.part_blocks(sets, 0.85).collect():
        met.setdefault(r.block, set()).add(r.id)
    pairs = {(i, j) for ids in met.values() for i in ids for j in ids if i < j}
    assert (0, 60) in pairs
    assert len(pairs) < 110  # with the blocks of one-word parts, about 160


def test_short_unlike_rows_with_frequent_words_seldom_meet(spark):
    rng = random.Random(9)
    rows = [(i, "a", " ".join(words("of", 30) + [f"unusual{i}_{k}" for k in range(rng.randrange(70, 80))]))
            for i in range(60)]
    rows.append((60, "a", " ".join(rows[0][2].split()[:-7] + words("newer", 7))))
    sets = materialize(
        dedup.token_sets(spark.createDataFrame(rows, SCHEMA), "id", "stratum", "text"), "sets")
    met = {}
    for r in dedup.part_blocks(sets, 0.85).collect():
        met.setdefault(r.block, set()).add(r.id)
    pairs = {(i, j) for ids in met.values() for i in ids for j in ids if i < j}
    assert (0, 60) in pairs
    assert len(pairs) < 30  # if the weakest parts stay, about 100


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_long_similar_rows_meet_at_the_threshold(spark, threshold):
    rng = random.Random(4)
    rows, most = [], (1 - threshold) / (1 + threshold)
    for k in range(40):
        n = rng.randrange(220, 600)
        base = words(f"k{k}_", n)
        out = int(n * most)  # so many words replaced: similarity just above the threshold
        rows += [(2 * k, "a", " ".join(base)), (2 * k + 1, "a", " ".join(base[out:] + words(f"r{k}_", out)))]
    assert kept(spark, rows, threshold) == greedy(rows, threshold) == list(range(0, 80, 2))
