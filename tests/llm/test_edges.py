"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillmill.llm.cascade import cascade
from quillmill.llm.chat import perspectives
from quillmill.llm.decontaminate import decontaminate
from quillmill.llm.linkgraph import judge_urls
from quillmill.llm.mixing import temperature_mix
from quillmill.llm.pii import sanitise
from quillmill.llm.probminhash import drop_near_duplicates, near_duplicates
from quillmill.llm.pseudo_likelihood import _stream, log_probs, score, train
from quillmill.llm.sharding import shard_by_bytes
from quillmill.llm.warc import archive_and_read
from quillmill.session import scratch_path
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, kept string, size string, `__uid` string"
LONG = " ".join(f"word{i}" for i in range(30_000)) + " mail@example.org"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
TEXTS = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, LONG, "b"), (5, PROSE, "a"),
    (5, PROSE, "a"), (6, PROSE, None), (None, PROSE, "b"), (7, "x y €\U0001f600 +1 (555) 010-9999.", "b"),
    (8, "one two", "b"), (9, PROSE + " rho", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "k", "s", "u") for t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none):
    got = shard_by_bytes(docs, 3).collect()
    assert len(got) == len(TEXTS) and got[0]["kept"] == "k"
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard_by_bytes(none).count() == 0


def test_mixing(docs, none):
    got = temperature_mix(docs, max_epochs=2.0, block_tokens=1000).collect()
    assert len({(r["doc_id"], r["text"], r["source"]) for r in got}) == len(set(TEXTS))
    assert {r["epoch"] for r in got} == {0, 1}
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():  # a source fills its budget to less than one document
        tokens = sum(r["n_tokens"] for r in rows)
        assert rows[0]["budget"] <= tokens < rows[0]["budget"] + max(r["n_tokens"] for r in rows) + 1
    assert temperature_mix(none).count() == 0


def test_mixing_entropy(spark):
    rows = [(i, "w " * 10, "ab"[i >= 90]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = temperature_mix(docs, budget_tokens=1000, target_entropy=0.6, max_epochs=None)
    budgets = sorted(r[0] for r in got.select("budget").distinct().collect())
    p = budgets[0] / sum(budgets)
    import math
    assert abs(-(p * math.log(p) + (1 - p) * math.log(1 - p)) - 0.6) < 0.01
    assert abs(sum(budgets) - 1000) <= 2


def test_cascade(docs, none):
    got = cascade(docs, measures=True).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute.quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"], r["base_failed"]) == want
        assert r["kept"] is (r["rejected_by"] is None) and not (r["kept"] and want[5])
    assert cascade(none).count() == 0


def test_cascade_order_does_not_decide(docs):
    first = {r["text"]: r["kept"] for r in cascade(docs, sample_rows=1).collect()}
    assert first == {r["text"]: r["kept"] for r in cascade(docs).collect()}


def test_near_duplicates(docs, none):
    got = near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(classes[5]) == [5, 5, 6, 9] and classes[1] == [1] and classes[2] == [2]
    kept = sorted((r["doc_id"] for r in got if r["kept"]), key=str)
    assert kept == [1, 2, 3, 4, 5, 7, 8, None]
    rest = drop_near_duplicates(docs)
    assert sorted((r["doc_id"] for r in rest.collect()), key=str) == kept
    assert rest.columns == [c for c in docs.columns if not c.startswith("__")]
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    other = " ".join(f"unlike{i}" for i in range(40))
    rows = [(1, PROSE), (2, PROSE), (2, "z" + other), (2, "z" + other), (2, None), (2, " "), (3, other)]
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, PROSE), (2, "z" + other), (2, None), (2, " ")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_crowd_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + ["new"] + words[i + 1:])) for i in range(200)]
    rows += [(1000 + i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == brute.classes(rows[:2] + rows[200:]) | {i: 0 for i in range(200)}


BENCH = [(1, PROSE), (1, PROSE), (2, "Two  ONE"), (None, "x y"), (3, None), (4, "")]


@pytest.mark.parametrize("block", [512 << 10, 10])
def test_decontaminate(spark, docs, none, block):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate(docs, bench, max_block_bytes=block).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            brute.contamination(r["text"], BENCH)
        )
        for s in r["hit_spans"]:
            assert brute.BENCH_WORD.search(r["text"][s["start"]:s["end"]])
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_spans_are_those_of_the_original(spark):
    text = "Äh, " + PROSE.upper().replace(" ", " -- ") + "!"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    row = decontaminate(docs, bench).first()
    assert [text[s["start"]:s["end"]] for s in row["hit_spans"]] == [text[4:-1]]


def test_pii(spark, docs, none):
    tricky = [
        "a@b.c%d@e.f x@y z@q.r..s@t.u", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.0.0.1",
        "4111 1111-1111 1111 1 4111111111111111 +49 (30) 901820-0. +1 2", "a" * 50_000 + "@",
        "1" * 50_000, "+" + "1 " * 20_000, "a@b" + ".c" * 20_000,
    ]
    rows = [(100 + i, t) for i, t in enumerate(tricky)]
    got = {r["doc_id"]: r for r in sanitise(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.pii_digest(t)
    out = sanitise(docs).collect()
    assert len(out) == len(TEXTS)
    assert [r["sanitised"] for r in out if r["doc_id"] == 5] == [PROSE, PROSE]
    assert [r["sanitised"][-8:] for r in out if r["doc_id"] == 4] == [" <EMAIL>"]
    assert sanitise(none).count() == 0


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"please ask zork about ann{i % 2}@example.org today") for i in range(0, 12, 2)]
    rows += [(100 + i, "please ask somebody about it today") for i in range(60)]
    got = {r["doc_id"]: r for r in sanitise(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "email:22:38,term:11:15"
    assert got[0]["sanitised"] == "please ask  about <EMAIL> today"
    assert got[100]["sanitised"] == rows[-1][1] and got[100]["spans"] == ""


def test_pii_terms_in_whole_documents(spark):
    far = "some words that lie in between and are in all of these documents " * 3
    rows = [(i, f"Zork wrote {far}to ann@example.org and then {far}zork. x zorks") for i in range(6)]
    rows += [(100 + i, f"somebody wrote {far}to and then x zorks") for i in range(60)]
    rows += [(200, "a@b.example"), (200, "a@b.example")]  # an entity without a word around
    got = {r["doc_id"]: r for r in sanitise(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        at = [0, rows[i][1].index("zork.")]
        assert got[i]["spans"].split(",")[1:] == [f"term:{s}:{s + 4}" for s in at]
        assert got[i]["sanitised"] == f" wrote {far}to <EMAIL> and then {far}. x zorks"
    assert got[100]["spans"] == "" and got[200]["spans"] == "email:0:11"


def test_pii_terms_of_rare_values(spark):
    rows = [(i, f"zork and w{i} met u{i % 7} for p{i}@{'ab'[i % 2]}.example or +49 30 90182{i:02}")
            for i in range(12)]
    rows += [(50 + i, f"mail of ann@c{i % 3}.example on q{i % 2} by r{i}") for i in range(6)]
    rows += [(100 + i, f"and met for w{i % 9 + 6} or u{i % 5}") for i in range(200)]
    got = {r["doc_id"]: r["spans"].split(",") for r in sanitise(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.disclosed(rows)
    assert {d: sorted(s for s in spans if s.startswith("term:")) for d, spans in got.items()} == {
        d: sorted(f"term:{s}:{e}" for s, e in want[d]) for d, _ in rows}
    assert all(want[i] for i in range(12)) and not any(want[100 + i] for i in range(200))


def test_pii_planted_words_are_found_and_rare_ones_stay(spark):
    """Names next to values that several texts share, in prose with a tail of rare words."""
    import random

    draw = random.Random(4)
    common = [f"common{i}" for i in range(400)]
    rows, planted, rare = [], set(), set()
    for i in range(600):
        text = [draw.choice(common) for _ in range(40)]
        text += [f"rare{i}x{j}" for j in range(5)]
        if i < 150:
            person = i % 30
            text += [f"Name{person}", f"person{person}@host{person}.example", f"account{person}"]
            planted |= {(i, f"name{person}"), (i, f"account{person}")}
            rare |= {(i, f"rare{i}x{j}") for j in range(5)}
        head = text[:1]
        draw.shuffle(text)
        rows.append((i, " ".join(head + text)))
    found = set()
    got = sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        for span in r["spans"].split(","):
            if span.startswith("term:"):
                s, e = map(int, span.split(":")[1:])
                found.add((r["doc_id"], r["text"][s:e].lower()))
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found & planted) >= 0.9 * len(found)
    assert not found & rare


def test_pii_spelling_of_a_number_does_not_part_it(spark):
    rows = [(i, f"zork {'+44 20 7946 0958' if i % 2 else '+442079460958'} w{i}") for i in range(8)]
    rows += [(100 + i, f"w{i % 8} and nothing else {i}") for i in range(80)]
    got = sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("term:0:4" in r["spans"] for r in got if r["doc_id"] < 8)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"),
            (1, 3, None, None), (None, None, "ann", "x"), (2, 0, "system", "alone")]
    got = {(r["conv_id"], r["participant"], r["part"]): r for r in perspectives(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
        turns_per_row=2).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob") for k in range(3)} | {(None, "ann", 0)}
    for p, said in (("ann", ["hi"]), ("bob", ["yo", "yo"])):
        whole = "".join(got[1, p, k]["rendered"] for k in range(3))
        spans = [s for k in range(3) for s in got[1, p, k]["mask"].split(",") if s]
        texts = [whole[int(s.split(":")[0]):int(s.split(":")[1])] for s in spans]
        assert texts == [t + "<|im_end|>\n" for t in said]
        assert whole.count("<|im_start|>assistant") == len(said)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert perspectives(empty).count() == 0


def test_perspectives_of_long_turns_and_hot_dialogues(spark):
    rows = [(7, i, f"p{i % 3}", ("x" * 50_000 if i == 5 else f"turn {i} €"), "en") for i in range(700)]
    rows += [(8, 0, "p0", "hi", "de"), (8, 1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = perspectives(df, turns_per_row=64).collect()
    for p in range(3):
        mine = sorted((r["part"], r) for r in got if r["conv_id"] == 7 and r["participant"] == f"p{p}")
        whole = "".join(r["rendered"] for _, r in mine)
        at = 0
        for i, (part, r) in enumerate(mine):
            assert (part, r["char_start"], r["first_turn"]) == (i, at, 64 * i)
            at += len(r["rendered"])
        spans = [s.split(":") for _, r in mine for s in r["mask"].split(",") if s]
        assert [whole[int(a):int(b)] for a, b in spans] == [
            t + "<|im_end|>\n" for c, i, who, t, _ in rows if c == 7 and who == f"p{p}"]
    assert [r["rendered"] for r in got if r["conv_id"] == 8] == [
        "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"]


def test_pseudo_likelihood(spark, docs, none):
    import random

    draw = random.Random(1)
    def line(n):
        return " ".join(w for _ in range(n) for w in draw.choice(["a b c d", "e f g h", "i j k l"]).split())
    rows = [(i, line(60)) for i in range(120)]
    model = train(spark.createDataFrame(rows[:100], "doc_id long, text string"), every=2)
    held = []
    for i, t in rows[100:]:
        words = t.split()
        draw.shuffle(words)
        held += [(i, t), (1000 + i, " ".join(words))]
    got = {r["doc_id"]: r["mean_log_prob"] for r in score(
        spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert all(got[i] > got[1000 + i] + 0.2 for i, _ in rows[100:])
    scored = score(docs, model).collect()
    assert len(scored) == len(TEXTS)
    assert {r["n_tokens"] for r in scored if not (r["text"] or "").strip()} == {0}
    assert score(none, train(none)).count() == 0


def test_pseudo_likelihood_is_that_of_the_word(spark):
    from collections import Counter

    import numpy as np

    rows = [(i, " ".join(f"{'ab'[i % 2]}{j % 50} tail{i}x{j}" for j in range(600)) + " end")
            for i in range(100)] + [(100, None), (100, "a1 a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = train(docs)
    words = Counter(w for _, t in rows for w in (t or "").split())
    assert {bytes(r["word"]).decode(): r["n"] for r in model.words.collect()} == words
    assert b"a1" in model.common and b"tail1x1" not in model.common  # both ways of the look-up
    held = [(1000, rows[0][1]), (1001, rows[0][1].replace("tail0x7", "a0")),
            (1002, rows[0][1].replace("tail0x7 ", "never-seen ")), (1002, None)]
    classes = {}
    for w in words:
        c = int(_stream([w], model.classes)[0][2])
        classes[c] = classes.get(c, 0) + words[w]
    for part in (rows, held):
        got = score(spark.createDataFrame(part, "doc_id long, text string"), model).collect()
        assert len(got) == len(part)
        by = {(r["doc_id"], r["text"]): r for r in got}
        for d, t in part:
            stream, at, _ = _stream([t], model.classes)
            want = log_probs(model.weights, stream, at).sum() + sum(
                np.log(words.get(w, 0.5) / classes[c])
                for w, c in zip((t or "").split(), stream[at].tolist()))
            assert abs(by[d, t]["log_prob"] - want) < 0.02 and by[d, t]["n_tokens"] == len(at)


def test_pseudo_likelihood_trains_on_every_position(spark):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(i))) for i in range(200)] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len((t or "").split()) for _, t in rows)
    one, other = train(docs.coalesce(1)), train(docs.repartition(5, "doc_id"))
    assert sum(one.trained) == total and one.trained == other.trained  # whatever the file layout
    assert sum(train(docs, rounds=1, every=3).trained) == total
    assert train(docs, every=1).trained == [total, total]


def test_pseudo_likelihood_does_not_depend_on_the_file_layout(spark, monkeypatch):
    from quillmill.llm import pseudo_likelihood as module

    monkeypatch.setattr(module, "TRAINER_WORDS", 5_000)  # several trainers on a small corpus
    rows = [(i, " ".join(f"w{(i * j + j * j) % 211}" for j in range(i + 20))) for i in range(200)]
    rows += [(7, None), (8, ""), (9, rows[9][1]), (9, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models, scores = [], []
    for dealt in (docs.coalesce(1), docs.repartition(3), docs.repartition(8, "text")):
        models.append(train(dealt))
        scores.append(sorted(map(tuple, score(dealt, models[-1], with_text=False).collect()), key=str))
    assert len(scores[0]) == len(rows)
    for model, got in zip(models[1:], scores[1:]):
        assert all((model.weights[k] == models[0].weights[k]).all() for k in model.weights)
        for one, other in zip(scores[0], got):  # matrix products of other heights round otherwise
            assert one[:2] == other[:2] and abs(one[2] - other[2]) < 1e-3


def test_warc(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "a b", None), (4, "u", ""), (3, "u", "same"),
            (5, "u", "x" * 300_000), (None, "u", "same")]
    records = spark.createDataFrame(rows, "record_id long, uri string, payload string")
    got = archive_and_read(records, scratch_path(spark, "warc")).collect()
    assert len(got) == len(rows)
    want = brute.warc([(r[0], r[2]) for r in rows if r[0] is not None])
    for r in got:
        if r["record_id"] != "null":
            refers = None if r["refers_to"] is None else int(r["refers_to"])
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], refers) == want[int(r["record_id"])]
    assert archive_and_read(records.where("false"), scratch_path(spark, "warc")).count() == 0


def test_links_spread_trust_and_distrust(spark):
    rules = [("allow", "good.org", "/"), ("block", "bad.org", "/")]
    link = '<a href="http://{}/x">l</a>'.format
    rows = [(1, "http://good.org/", link("fine.org")), (2, "http://fine.org/", link("Fine2.org") * 3),
            (3, "http://farm.org/", link("bad.org")), (4, "http://bad.org/", None),
            (5, "http://fine2.org/?q=http://bad.org", '<a href="/a?u=http://bad.org">'),
            (6, None, link("bad.org")), (7, "mailto:x", ""), (1, "http://good.org/", link("fine.org"))]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules)
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [by[i]["verdict"] for i in (1, 2, 3, 4, 5, 6, 7)] == [
        "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert by[2]["trust"] == int(by[1]["trust"] * 0.85) and by[5]["trust"] > 0 and by[6]["host"] == ""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(empty).count() == 0


def test_a_wide_benchmark_reads_the_documents_as_often_as_two_blocks(spark):
    import random

    draw = random.Random(3)
    items = [(f"i{k}", " ".join(f"w{draw.randrange(400)}" for _ in range(draw.choice([1, 5, 13, 40]))))
             for k in range(120)] + [("none", None), ("blank", " .")]
    rows = []
    for i in range(150):
        words = [f"v{draw.randrange(300)}" for _ in range(60)]
        if i % 5 == 0:
            words[20:20] = draw.choice(items[:120])[1].split()
        rows.append((i, " ".join(words) + " é."))
    rows += [(150, None), (0, rows[0][1]), (151, "x")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    read = []
    for size in (2_000, 200):
        count = spark.sparkContext.accumulator(0)

        def counted(batches, count=count):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        docs = spark.createDataFrame(rows, "doc_id long, text string")
        docs = docs.mapInArrow(counted, docs.schema)
        for bits in (1 << 30, 1 << 16):
            got = decontaminate(docs, bench, max_block_bytes=size, most_filter_bits=bits).collect()
            assert len(got) == len(rows)
            for r in got:
                assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == \
                    brute.contamination(r["text"], items)
        read.append(count.value)
    assert read[0] == read[1] == 4 * len(rows)  # two bitmaps: once to choose, once to mark


def test_small_shares_are_kept_whole(spark):
    rows = [(1, " ".join(f"v{i}" for i in range(3_999)) + " w0"), (2, "v1 w0")]
    bench = spark.createDataFrame([("a", "w0")], "item_id string, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share, want in ((0.0004, [False, True]), (0.00025, [True, True])):
        got = decontaminate(docs, bench, share=share).orderBy("doc_id").collect()
        assert [r["contaminated"] for r in got] == want


def test_pseudo_likelihood_looks_a_word_up_once(spark, monkeypatch):
    from collections import Counter

    from quillmill.llm import pseudo_likelihood as module

    texts = [" ".join(f"w{i * k % 9001}" for k in range(i)) for i in range(0, 700, 7)] + [None, "", "w1 w1"]
    counted, numbers = Counter(), module._Numbers()
    for text in texts:
        counted.update((text or "").encode().split())
        assert numbers.buckets(text).tolist() == module.buckets(text).tolist()
        numbers.count(1000)
    assert len(counted) > 4096 and numbers.total() == counted
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(df)
    assert {bytes(r["word"]): r["n"] for r in model.words.collect()} == counted
    want = score(df, model).orderBy("doc_id").collect()
    monkeypatch.setattr(module, "KNOWN", 10)
    assert score(df, model).orderBy("doc_id").collect() == want
