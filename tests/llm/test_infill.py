"""Fill-in-the-middle rows: edges, parameters and the exact way back."""

import hashlib
import re

from pyspark.sql import functions as F

from quillmill.llm.infill import infill, restore

SCHEMA = "doc_id long, text string, n string, Output string, `__a` string, lang string"
MANY = "x\n" * 60_000
TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\nb\nc\nd"), (5, "a\nb\nc\nd"),
    (6, "\r\n\n $1 \\ \U0001f600\né\nend"), (7, "x <P> y"), (8, "<S>"), (9, "a<M>\nb"),
    (None, "k\nl\n"), (10, MANY), (11, "w" * 300_000 + "\nz"), (12, "<P\nS>\n<<M"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "n", "o", "u", "en") for r in rows], SCHEMA)


def plain(doc_id, text, unit, seed, percent, spm_percent):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_percent:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def check(spark, unit, **more):
    frame = docs(spark)
    got = restore(infill(frame, unit=unit, **more)).collect()
    given = {"seed": 7, "percent": 100, "spm_percent": 50, **more}
    assert sorted((str(tuple(r[c] for c in ("doc_id", "n", "form", "output", "prefix_chars",
                                            "middle_chars"))) for r in got)) == sorted(
        str((d, *plain(d, t, unit, **given))) for d, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted(
        (str(d), t or "") for d, t in TEXTS)
    return got


def test_lines(spark):
    got = check(spark, r"[^\n]*\n|[^\n]+")
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "n", "form", "output",
                                    "prefix_chars", "middle_chars", "restored"}


def test_other_units_seeds_and_rates(spark):
    check(spark, r"\s+|\S+", seed=3, percent=60, spm_percent=0)
    check(spark, r"(?s).", seed=11, spm_percent=100)


def test_markers_with_pattern_characters(spark):
    frame = docs(spark)
    marks = ("[$1]", "(\\S)", "{m}")
    got = restore(infill(frame, markers=marks), markers=marks).collect()
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted(
        (str(d), t or "") for d, t in TEXTS)
    assert any(r["form"] != "plain" and "[$1]" in r["output"] for r in got)


def test_every_cut_is_a_unit_boundary(spark):
    rows = [(i, "".join(f"line {j}\n" for j in range(i % 7)) + "tail") for i in range(300)]
    got = infill(docs(spark, rows)).collect()
    forms = {r["form"] for r in got}
    assert forms == {"psm", "spm"}
    for r in got:
        edges = {0}
        for line in r["text"].splitlines(keepends=True):
            edges.add(max(edges) + len(line))
        assert r["prefix_chars"] in edges and r["prefix_chars"] + r["middle_chars"] in edges


def test_empty_table(spark):
    none = docs(spark).where(F.lit(False))
    assert restore(infill(none)).count() == 0
