"""Spread of trust and distrust against plain PageRank, and verdicts at the edges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmill.llm.linkgraph import RULES, UNIT, judge_urls, propagate
from tests.llm import brute


def plain(edges, seeds, damping=0.85, rounds=400):
    """{host: (trust, distrust)} in units, at the limit."""
    out = {}
    for kind in ("trust", "distrust"):
        links = defaultdict(list)
        for (a, b), n in edges.items():
            a, b = (a, b) if kind == "trust" else (b, a)
            links[a].append((b, n))
        given = {h: (1 - damping) * w for (h, k), w in seeds.items() if k == kind}
        score = dict(given)
        for _ in range(rounds):
            after = defaultdict(float, given)
            for a, s in score.items():
                total = sum(n for _, n in links[a])
                for b, n in links[a]:
                    after[b] += damping * s * n / total
            score = after
        for h, s in score.items():
            out.setdefault(h, {})[kind] = s
    return {h: (s.get("trust", 0), s.get("distrust", 0)) for h, s in out.items()}


def spread(spark, edges, seeds, **more):
    got = propagate(
        spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"),
        spark.createDataFrame([(h, k, w) for (h, k), w in seeds.items()],
                              "host string, kind string, weight double"), **more)
    return {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}


@pytest.mark.parametrize("hub", [False, True])
def test_scores_equal_page_rank(spark, hub):
    draw = random.Random(9)
    hosts = [f"h{i}.example" for i in range(200)]
    edges = defaultdict(int)
    for _ in range(700):
        a, b = draw.sample(hosts, 2)
        edges[a, b] += draw.randrange(1, 4)
    if hub:
        edges |= {(hosts[0], h): 1 for h in hosts[1:]} | {(h, hosts[0]): 2 for h in hosts[100:]}
    seeds = {(h, k): draw.choice([0.1, 0.5, 1.0]) for h in hosts[:30] for k in ("trust", "distrust")
             if draw.random() < 0.5}
    got, want = spread(spark, edges, seeds), plain(edges, seeds)
    for host, scores in want.items():
        for mine, exact in zip(got.get(host, (0, 0)), scores):
            assert abs(mine - exact * UNIT) <= UNIT // 10_000 + 20 * len(hosts)


def test_long_chains_settle(spark):
    edges = {(f"h{i}", f"h{i + 1}"): 1 for i in range(60)}
    seeds = {("h60", "distrust"): 1.0}
    got, want = spread(spark, edges, seeds, tolerance=100), plain(edges, seeds)
    for i in range(61):
        assert abs(got.get(f"h{i}", (0, 0))[1] - want[f"h{i}"][1] * UNIT) <= 2_000


def test_few_blocked_pages_judge_those_that_link_to_them(spark):
    rules = [("block", "bad.example", "/x/"), ("block", "worse.example", "/")]
    rows = [(i, f"http://bad.example/{'x' if i < 3 else 'y'}/{i}", "") for i in range(10)]
    rows += [(20, "http://friend.example/", '<a href="http://bad.example/y/">'),
             (21, "http://other.example/", None), (22, "http://worse.example/", ""),
             (23, "http://fan.example/", '<a href=http://worse.example/>')]
    got = {r["page_id"]: r for r in judge_urls(
        spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [got[i]["verdict"] for i in range(10)] == ["block"] * 3 + ["allow"] * 7
    assert got[20]["verdict"] == "block" and got[20]["distrust"] > 0
    assert got[21]["verdict"] == "allow" and got[23]["verdict"] == "block"
    assert got[23]["distrust"] == int(got[22]["distrust"] * 0.85)


def test_edges(spark):
    long = "".join(f'<a href="http://h{i % 50}.example/">x</a> ' for i in range(20_000))
    rows = [(1, "http://EXAMPLE.com/en/x", long), (1, "http://EXAMPLE.com/en/x", long), (2, None, None),
            (None, "http://www.example.com/en/", ""), (3, "no scheme", long), (4, "http://a.net/fr/?q", ""),
            (5, "http://a.net/fr", ""), (6, "http://", ""), (7, "http://x.com#f", "")]
    df = spark.createDataFrame([(*r, "h", 5) for r in rows],
                               "page_id long, url string, html string, host string, Trust int")
    got = judge_urls(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {
        "page_id", "url", "html", "host", "path", "rule", "verdict", "trust", "distrust"}
    for r in got:
        best = brute.rule(r["url"], RULES)
        assert (r["host"], r["path"]) == brute.host_path(r["url"])
        assert (r["rule"], r["verdict"]) == ((best[1], best[0]) if best else (None, "allow"))
    twice = judge_urls(df, [*RULES, *RULES]).collect()  # ties of rules
    assert sorted(map(str, twice)) == sorted(map(str, got))
    assert judge_urls(df.where(F.lit(False))).count() == 0
