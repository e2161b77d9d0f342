"""The whole curation chain, from records to the split and its distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import Tables, words
from checks.registry import query
from quillmill.plans.curation import curate

CHAIN = f"""sets AS (SELECT sample_id AS id, clause_type AS s,
        list_sort(list_distinct({words("lower(contract_text)")})) AS t FROM samples),
    tk AS MATERIALIZED (SELECT id, s, len(t) AS n, unnest(t) AS w FROM sets),
    shared AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.n AS na, b.n AS nb, count(*) AS c
        FROM tk a JOIN tk b ON a.s = b.s AND a.w = b.w AND a.id < b.id
        AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 0.000001 GROUP BY ALL),
    later AS MATERIALIZED (SELECT j AS id, list(i) AS earlier, row_number() OVER (ORDER BY j) AS k
        FROM shared WHERE c::DOUBLE / (na + nb - c) >= 0.85::DOUBLE GROUP BY j),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
        SELECT l.k, CASE WHEN len(list_filter(l.earlier, lambda x: NOT list_contains(w.gone, x))) > 0
            THEN list_append(w.gone, l.id) ELSE w.gone END
        FROM walk w JOIN later l ON l.k = w.k + 1),
    kept AS MATERIALIZED (SELECT * FROM formatted WHERE sample_id NOT IN (
        SELECT unnest(gone) FROM walk WHERE k = (SELECT max(k) FROM walk))),
    tokens AS (SELECT sample_id, unnest({words("lower(contract_text)")}) AS token FROM kept),
    freq AS (SELECT token, count(*) AS count FROM tokens GROUP BY token),
    lp AS (SELECT token, round(ln(count::DOUBLE / (SELECT sum(count) FROM freq) + 1e-10)
        * 10000000000)::BIGINT AS units FROM freq),
    ppl AS MATERIALIZED (SELECT sample_id, count(*) AS n,
        round(exp(-sum(units)::BIGINT / (count(*) * 10000000000.0::DOUBLE)) * 10000)::BIGINT AS key
        FROM tokens JOIN lp USING (token) GROUP BY sample_id),
    band AS (SELECT quantile_cont(key, 0.05) AS lo, quantile_cont(key, 0.95) AS hi
        FROM ppl WHERE n >= 10),
    clean AS (SELECT kept.* FROM kept LEFT JOIN ppl USING (sample_id), band
        WHERE (n >= 10 AND key BETWEEN lo AND hi) OR (SELECT count(*) FROM kept) < 20),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clause_type
        ORDER BY md5('42|split|' || sample_id), sample_id) AS rn,
        count(*) OVER (PARTITION BY clause_type) AS n FROM clean),
    curated AS (SELECT *, CASE WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'test'
        WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE))
        THEN 'val' ELSE 'train' END AS split FROM ranked)"""


@query("curate", CHAIN + """ == SELECT sample_id, clause_type, md5(prompt) AS prompt_md5,
    md5(text) AS text_md5, source_length, split FROM curated""")
def curated(t: Tables) -> DataFrame:
    return curate(t.qa).select(
        "sample_id", "clause_type", F.md5("prompt").alias("prompt_md5"),
        F.md5("text").alias("text_md5"), "source_length", "split",
    )


@query("curated_card", CHAIN + """ == SELECT clause_type, count(*) AS samples,
    count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
    count(*) FILTER (WHERE split = 'test') AS test FROM curated GROUP BY clause_type""")
def curated_card(t: Tables) -> DataFrame:
    return curate(t.qa).groupBy("clause_type").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
    )
