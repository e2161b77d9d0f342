"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.byte_bpe import decode, encode
from quillmill.llm.cascade import cascade
from quillmill.llm.chat import perspectives
from quillmill.llm.common import table
from quillmill.llm.decontaminate import decontaminate
from quillmill.llm.infill import infill, restore
from quillmill.llm.linkgraph import judge_urls
from quillmill.llm.mixing import temperature_mix
from quillmill.llm.pii import sanitise
from quillmill.llm.probminhash import near_duplicates
from quillmill.llm.pseudo_likelihood import pseudo_likelihood
from quillmill.llm.ranked_search import search
from quillmill.llm.sharding import shard_by_bytes
from quillmill.llm.warc import archive_and_read
from quillmill.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_warc_dictionary")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record_id"), F.col("url").alias("uri"),
        F.col("html").cast("binary").alias("payload"),
    )
    read = archive_and_read(pages, scratch_path(spark, "warc"))
    return read.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes",
        "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query("op2_temperature_mix", r"""
WITH RECURSIVE d AS (SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
        md5('42|mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS g
        FROM documents),
    s AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
    r AS MATERIALIZED (SELECT max(tokens) AS most, greatest(0.0, 1 - ln(2.0::DOUBLE)
        / ln(max(tokens)::DOUBLE / min(tokens))) AS need FROM s WHERE tokens > 0),
    a AS (SELECT most, ceil(need * 4294967296) / 4294967296.0::DOUBLE AS alpha,
        greatest(1, (most + 1048575) // 1048576) AS n_blocks FROM r),
    p AS MATERIALIZED (SELECT source, tokens,
        round(pow(tokens::DOUBLE / most, alpha) * most)::BIGINT AS budget, n_blocks FROM s, a),
    b AS MATERIALIZED (SELECT d.source, ('0x' || g[1:8])::BIGINT % n_blocks AS block, tokens, budget,
        sum(n_tokens) AS block_tokens FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
        GROUP BY ALL),
    e AS (SELECT *, unnest(range(greatest((budget - 1) // greatest(tokens, 1), 0) + 1)) AS epoch
        FROM b),
    o AS MATERIALIZED (SELECT source, block, epoch, budget, budget // greatest(tokens, 1) AS whole,
        coalesce(sum(block_tokens) OVER (PARTITION BY source ORDER BY epoch, md5('42|block|'
        || coalesce(source, 'null') || '|' || epoch || '|' || block), block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
    w AS (SELECT doc_id, d.source, n_tokens, ('0x' || g[1:8])::BIGINT % n_blocks AS block, g
        FROM d, a),
    q AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY g
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w)
SELECT doc_id, q.source, n_tokens, epoch::INTEGER AS epoch, q.block::BIGINT AS block,
    (start + off)::BIGINT AS position, budget
FROM q JOIN o ON q.source IS NOT DISTINCT FROM o.source AND q.block = o.block
WHERE epoch < whole OR start + off < budget
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = temperature_mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "n_tokens", "epoch", "block",
        F.col("position").cast("bigint").alias("position"), "budget",
    )


@query("op3_perspective_rotation", r"""
WITH t AS (SELECT conv_id, role, coalesce(text, '') || '<|im_end|>' || chr(10) AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
        text NULLS FIRST) - 1 AS i FROM conversations),
    p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations
        WHERE role IS NOT NULL AND role <> 'system'),
    r AS (SELECT t.conv_id, participant, i, i // 256 AS part, body,
        coalesce(role = participant, false) AS own, '<|im_start|>' || CASE
        WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system'
        ELSE 'user name=' || regexp_replace(coalesce(role, 'unknown'), '[<>|\s]', '_', 'g') END
        || chr(10) AS head FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant
        ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT conv_id, participant, part::INTEGER AS part, min(i) AS first_turn,
    count(*)::INTEGER AS n_turns, min(pos)::BIGINT AS char_start,
    string_agg(head || body, '' ORDER BY i) AS rendered,
    coalesce(string_agg((pos + length(head))::VARCHAR || ':' || (pos + length(head) + length(body)), ','
        ORDER BY i) FILTER (WHERE own), '') AS mask,
    coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_target
FROM o GROUP BY conv_id, participant, part
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


@query("op4_pii_disclosure")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


@query("op5_shard_prefix_sums")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_rule_cascade")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), measures=True)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"),
    )


@query("op7_probminhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_pseudo_likelihood")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo_likelihood(docs, with_text=False).select(
        "doc_id", "n_tokens", "log_prob", "mean_log_prob"
    )


@query("op9_decontaminate")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
    ).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_link_graph")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "host", "path", "rule", "verdict", "trust", "distrust"
    )


@query("op11_counted_infill", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))
        AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(lines)::BIGINT AS n, CASE WHEN t = '' OR contains(t, '<P>')
        OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
        greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
    p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix,
        array_to_string(lines[a + 1:b], '') AS middle,
        array_to_string(lines[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(infill(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@query("op12_nra_search", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term, r
        FROM (SELECT *, row_number() OVER () AS r FROM documents)),
    q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id,
        unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
    s AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
    a AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM s),
    v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM tf, a GROUP BY term, docs),
    i AS (SELECT tf.r, tf.doc_id, tf.term, v.w * ((1000000000 * tf) // (1000 * tf
        + 12 * (100 - 25 + (25 * n * docs) // terms))) AS impact
        FROM tf JOIN s ON tf.r = s.r JOIN v ON tf.term = v.term, a
        WHERE tf.term IN (SELECT term FROM q)),
    g AS (SELECT item_id, r, doc_id, sum(times * impact)::BIGINT AS score
        FROM q JOIN i ON q.term = i.term GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC,
        doc_id NULLS FIRST)::INTEGER AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
    )


@query("op13_bpe_transducer")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(
        table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN
    )
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
