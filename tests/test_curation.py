"""Rules of curation on literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.operators import curate, perplexity, preference, prompts, reports, sampling
from quillmill.plans.curation import curate as run_curation
from quillmill.sources import io


def samples(spark, rows):
    """(id, class, text) rows as clause samples."""
    return spark.createDataFrame(
        [(i, c, t, "some clause text", f"question about {c}", len(t.split())) for i, c, t in rows],
        "sample_id bigint, clause_type string, contract_text string, answer string, "
        "question string, source_length int",
    )


@pytest.mark.parametrize("question, label", [
    ("Highlight the Governing Law clause", "Governing Law"),
    ("What about Audit Rights here?", "Audit Rights"),
    ("intellectual property terms", "IP Ownership Assignment"),
    ("Some totally unrelated question", "Other"),
    ("ANTI-ASSIGNMENT", "Anti-Assignment"),
    ("IP Ownership Assignment", "IP Ownership Assignment"),
    ("Assignment of rights", "Anti-Assignment"),
    (None, "Other"),
])
def test_class_is_the_first_keyword(spark, question, label):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(curate.clause_class(F.col("q"))).first()[0] == label


def test_flatten_gates_cuts_and_defaults(spark):
    def text(n):
        return " ".join(f"w{i}" for i in range(n))

    rows = [
        (0, text(49), "Governing Law", ["a"]),
        (1, "  " + text(50) + "\n", "Governing Law", []),
        (2, "a\t" + text(799), "Governing Law", [""]),
        (3, text(801), "Governing Law", [" x ", "y"]),
        (4, text(60), "nothing", ["a"]),
        (5, "a b " + text(48), "Governing Law", None),
        (6, None, "Governing Law", ["a"]),
    ]
    df = spark.createDataFrame(
        [(i, c, q, (a,)) for i, c, q, a in rows], io.QA_SCHEMA
    )
    got = {r.sample_id: r for r in curate.flatten_qa(df).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert got[1].contract_text == text(50) and got[1].answer == fixed.NO_ANSWER
    assert got[2].contract_text == "a\t" + text(799) and got[2].answer == ""
    assert got[3].contract_text == text(800) + " [...]" and got[3].answer == "x"
    assert got[3].source_length == 801 and got[2].source_length == 800
    assert got[5].source_length == 50  # a no-break space separates words


def test_filter_keeps_a_uniform_corpus(spark):
    text = " ".join(f"word{i % 30}" for i in range(60))
    df = samples(spark, [(i, "Governing Law", text) for i in range(40)])
    assert perplexity.filter_by_perplexity(df, "sample_id", "contract_text").count() == 40


def test_filter_passes_small_corpora_through(spark):
    df = samples(spark, [(i, "Governing Law", "short contract text here " * 5) for i in range(5)])
    kept = perplexity.filter_by_perplexity(df, "sample_id", "contract_text")
    assert sorted(kept.collect()) == sorted(df.collect())


def test_filter_without_finite_perplexity_is_empty(spark):
    df = samples(spark, [(i, "Governing Law", "too short") for i in range(25)])
    assert perplexity.filter_by_perplexity(df, "sample_id", "contract_text").count() == 0


@pytest.mark.parametrize("vocabulary_rows", [200_000, 0])
def test_perplexity_equals_plain_python(spark, vocabulary_rows):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{int(k)}" for k in rng.zipf(1.4, rng.integers(1, 80))) for _ in range(60)]
    df = samples(spark, [(i, "Governing Law", t) for i, t in enumerate(texts)])
    counts, total = {}, 0
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
            total += 1
    got = {
        r.sample_id: r.ppl for r in perplexity.perplexities(
            df, "sample_id", "contract_text", vocabulary_rows=vocabulary_rows).collect()
    }
    for i, t in enumerate(texts):
        words = t.split()
        if len(words) < 10:
            assert math.isinf(got[i])
        else:
            logs = [math.log(counts[w] / total + 1e-10) for w in words]
            assert got[i] == pytest.approx(math.exp(-sum(logs) / len(words)), abs=1e-3)


def split_counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_split_conserves_and_covers(spark):
    rows = [
        (3 * i + k, c, " ".join(f"w{j}" for j in range(50 + i)))
        for k, c in enumerate(["Governing Law", "Audit Rights", "Non-Compete"])
        for i in range(20)
    ]
    done = sampling.stratified_split(samples(spark, rows), "sample_id", "clause_type")
    assert split_counts(done) == {"train": 45, "val": 6, "test": 9}
    train = done.where("split = 'train'").select("clause_type").distinct().count()
    assert train == 3


def test_split_does_not_depend_on_partitions(spark):
    rows = [(i, "Governing Law", "x") for i in range(300)]
    a, b = (
        sampling.stratified_split(
            samples(spark, rows).repartition(n), "sample_id", "clause_type"
        ).select("sample_id", "split")
        for n in (1, 8)
    )
    assert sorted(a.collect()) == sorted(b.collect())


def test_split_of_tiny_strata(spark):
    rows, sizes = [], {"one": 1, "two": 2, "three": 3, "seven": 7}
    for name, n in sizes.items():
        rows += [(len(rows) + i, name, "x") for i in range(n)]
    done = sampling.stratified_split(samples(spark, rows), "sample_id", "clause_type")
    got = {(r.clause_type, r.split): r["count"]
           for r in done.groupBy("clause_type", "split").count().collect()}
    assert got == {
        ("one", "test"): 1, ("two", "test"): 1, ("two", "val"): 1, ("three", "test"): 1,
        ("three", "val"): 1, ("three", "train"): 1, ("seven", "test"): 1, ("seven", "val"): 1,
        ("seven", "train"): 5,
    }


def test_published_class_counts_give_the_published_split(spark):
    sizes = [320, 271, 82, 163, 87, 135, 95, 22]
    rows = [(1000 * k + i, f"class {k}", "x") for k, n in enumerate(sizes) for i in range(n)]
    done = sampling.stratified_split(samples(spark, rows), "sample_id", "clause_type")
    assert split_counts(done) == {"train": 886, "val": 115, "test": 174}


def test_prompt_inserts_text_without_touching_its_braces(spark):
    df = samples(spark, [(1, "Audit Rights", "see {clause_type} and {contract_text}")])
    row = prompts.format_as_instruction(df).first()
    assert "see {clause_type} and {contract_text}" in row.prompt
    assert row.prompt.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n")
    assert row.prompt.endswith("<|start_header_id|>assistant<|end_header_id|>\n\n")
    assert row.text == row.prompt + "some clause text<|eot_id|>"


def test_entity_swap_draws_per_match(spark):
    text = "Acme Inc. signed 2015 and 2031, not 20155, with Bolt Corp."
    df = spark.range(200).select(
        "id", preference.swap_entities(F.lit(text), F.col("id")).alias("t")
    )
    seen = [r.t for r in df.collect()]
    for t in seen:
        assert "Acme" not in t and "Bolt" not in t and "2015 " not in t and "20155" in t
        assert sum(t.count(p) for p in fixed.FAKE_PARTIES) == 2
    assert len(set(seen)) > 50
    same = spark.range(1).select(preference.swap_entities(F.lit("nothing here"), F.col("id")))
    assert same.first()[0] == "nothing here"


def test_pairs_of_one_class_use_the_fallback(spark):
    df = prompts.format_as_instruction(
        samples(spark, [(i, "Audit Rights", "text") for i in range(60)])
    )
    rows = preference.preference_pairs(df, "sample_id").collect()
    assert len(rows) == 60
    wrong = {r.rejected for r in rows if r.strategy == "wrong_clause"}
    assert wrong == {fixed.ONE_CLASS_REJECTION}
    assert {r.strategy for r in rows} == set(fixed.STRATEGIES)


def test_pairs_spread_a_small_class_over_salts(spark, monkeypatch):
    rows = [(i, "big", "text") for i in range(400)] + [(400, "small", "text")]
    df = prompts.format_as_instruction(samples(spark, rows))
    plain = sorted(preference.preference_pairs(df, "sample_id").collect())
    monkeypatch.setattr(preference, "ROWS_PER_ANSWER", 7)
    assert sorted(preference.preference_pairs(df, "sample_id").collect()) == plain
    assert len(plain) == 401


def test_curation_chain_and_card(spark):
    rng = np.random.default_rng(1)
    words = [f"v{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 70)) for _ in range(60)]
    rows = [
        (i, texts[i % 60], "Governing Law" if i % 3 else "Audit Rights", (["an answer"],))
        for i in range(120)
    ]
    done = run_curation(spark.createDataFrame(rows, io.QA_SCHEMA)).cache()
    assert done.count() == 54  # 60 distinct (copies keep their class), 3 + 3 outside the band
    assert done.select("sample_id").distinct().count() == done.count()
    card = reports.dataset_card(done, "contracts").first()
    assert card.splits.total == 54 == sum(card.clause_distribution.values())
    assert card.context_length_stats.median == 70.0 and card.answer_length_stats.p95 == 2.0
