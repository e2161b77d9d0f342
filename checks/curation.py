"""Sources, projections, near-duplicates, perplexity, splits and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    ASSISTANT, SYSTEM_TURN, Tables, classify, d, first, lit, n_words, prompt, strip, template,
    words,
)
from checks.registry import query
from quillmill.functions import fixed
from quillmill.functions.text import n_words as count_words
from quillmill.functions.text import strip as strip_text
from quillmill.operators import curate, dedup, dedup_index, perplexity, preference, prompts, sampling
from quillmill.sources import io, json_arrays
from quillmill.plans.preferences import validation_pairs
from quillmill.session import materialize, scratch_path


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def r4(name: str):
    return F.round(F.col(name), 4).alias(name)


# --- sources and sinks ------------------------------------------------------------------


@query("read_corpus", "SELECT doc_id, lang, n_chars, length(text) AS text_chars FROM documents")
def _(t: Tables):
    return t.documents.select(
        "doc_id", "lang", "n_chars", F.length("text").cast("bigint").alias("text_chars")
    )


@query(
    "flatten_qa",
    """SELECT sample_id, clause_type, md5(contract_text) AS text_md5, answer, question,
       source_length FROM samples""",
)
def _(t: Tables):
    return t.samples.select(
        "sample_id", "clause_type", F.md5("contract_text").alias("text_md5"), "answer",
        "question", "source_length",
    )


@query(
    "json_round_trip",
    "SELECT sample_id, clause_type, md5(contract_text) AS text_md5, answer FROM samples",
)
def _(t: Tables):
    path = scratch_path(t.spark, "documents")
    rows = t.samples.select("sample_id", "clause_type", "contract_text", "answer")
    io.write_documents(rows, path)
    return io.read_documents(t.spark, path, rows.schema).select(
        "sample_id", "clause_type", F.md5("contract_text").alias("text_md5"), "answer"
    )


@query(
    "json_array_round_trip",
    "SELECT sample_id, clause_type, md5(contract_text) AS text_md5, answer FROM samples",
)
def _(t: Tables):
    path = scratch_path(t.spark, "arrays")
    rows = t.samples.select("sample_id", "clause_type", "contract_text", "answer")
    json_arrays.write_array(rows, path)
    return json_arrays.read_arrays(t.spark, path, rows.schema).select(
        "sample_id", "clause_type", F.md5("contract_text").alias("text_md5"), "answer"
    )


SPLIT_CTE = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY clause_type
    ORDER BY md5('42|split|' || sample_id), sample_id) AS rn,
    count(*) OVER (PARTITION BY clause_type) AS n FROM formatted),
split_rows AS (SELECT *, CASE WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'test'
    WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val'
    ELSE 'train' END AS split FROM ranked)
"""


def split_rows(t: Tables):
    return sampling.stratified_split(t.formatted, "sample_id", "clause_type")


@query(
    "write_splits",
    SPLIT_CTE + "== SELECT sample_id, clause_type FROM split_rows WHERE split = 'val'",
)
def _(t: Tables):
    path = scratch_path(t.spark, "splits")
    io.write_splits(split_rows(t).select("sample_id", "clause_type", "split"), path)
    return io.read_split(t.spark, path, "val", "sample_id BIGINT, clause_type STRING")


@query(
    "training_export",
    SPLIT_CTE + "== SELECT md5(text) AS text_md5 FROM split_rows WHERE split = 'train'",
)
def _(t: Tables):
    train = split_rows(t).where(F.col("split") == "train")
    return io.training_export(train).select(F.md5("text").alias("text_md5"))


@query(
    "card_json",
    """SELECT '{"clause_type":"' || clause_type || '","rows":' || count(*) || '}' AS json
       FROM samples GROUP BY clause_type""",
)
def _(t: Tables):
    counts = t.samples.groupBy("clause_type").agg(F.count(F.lit(1)).alias("rows"))
    return io.as_json(counts)


@query(
    "reuse_result",
    "SELECT clause_type, count(*) AS rows FROM samples GROUP BY clause_type",
)
def _(t: Tables):
    path = scratch_path(t.spark, "result")
    counts = t.samples.groupBy("clause_type").agg(F.count(F.lit(1)).alias("rows"))
    io.reuse_or_compute(counts, path)
    return io.reuse_or_compute(counts.withColumn("rows", F.col("rows") * 0), path)


# --- projections ------------------------------------------------------------------------


@query("classify", f"""SELECT sample_id,
    {classify("lower(coalesce(question, ''))")} AS clause_type FROM qa""")
def _(t: Tables):
    return t.qa.select("sample_id", curate.clause_class(F.col("question")).alias("clause_type"))


@query("target_classes", "SELECT sample_id, clause_type FROM tagged WHERE clause_type <> 'Other'")
def _(t: Tables):
    tagged = t.qa.select(
        "sample_id", curate.clause_class(F.col("question")).alias("clause_type")
    )
    return tagged.where(curate.is_target(F.col("clause_type")))


@query("first_answer", """SELECT sample_id,
    CASE WHEN len(answers) > 0 THEN answers[1] ELSE 'No clause found.' END AS answer FROM qa""")
def _(t: Tables):
    return t.qa.select("sample_id", curate.first_answer(F.col("answers.text")).alias("answer"))


@query("word_gate", f"SELECT doc_id FROM documents WHERE {n_words('text')} >= 50")
def _(t: Tables):
    return t.documents.where(curate.long_enough(F.col("text"))).select("doc_id")


@query("word_cut", f"""cut_docs AS (SELECT doc_id, CASE WHEN {n_words('text')} > 800
    THEN {first('text', 800)} || ' [...]' ELSE {strip('text')} END AS cut FROM documents)
    == SELECT doc_id, md5(cut) AS cut_md5, {n_words('cut')} AS words FROM cut_docs""")
def _(t: Tables):
    cut = t.documents.select("doc_id", curate.cut_context(F.col("text")).alias("cut"))
    return cut.select(
        "doc_id", F.md5("cut").alias("cut_md5"), count_words(F.col("cut")).alias("words")
    )


@query("instruction_format", """SELECT sample_id, md5(prompt) AS prompt_md5, md5(text) AS text_md5,
    length(text) AS text_chars FROM formatted""")
def _(t: Tables):
    return t.formatted.select(
        "sample_id", F.md5("prompt").alias("prompt_md5"), F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("text_chars"),
    )


CHAT_TEXT = """'<|begin_of_text|>' || string_agg('<|start_header_id|>' || role ||
    '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn)"""


@query("chat_template", f"""SELECT conv_id, {CHAT_TEXT} || '<|start_header_id|>assistant' ||
    '<|end_header_id|>' || chr(10) || chr(10) AS text FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    messages = t.table("conversations").withColumnRenamed("text", "content")
    return prompts.chat_texts(messages, "conv_id", add_generation_prompt=True)


@query("serving_prompt", f"""SELECT sample_id,
    md5({prompt("clause_type", "substr(contract_text, 1, 600)")}) AS short_md5,
    md5({prompt("clause_type", "substr(contract_text, 1, 2500)")}) AS long_md5 FROM samples""")
def _(t: Tables):
    clause, text = F.col("clause_type"), F.col("contract_text")
    return t.samples.select(
        "sample_id",
        F.md5(prompts.prompt_text(clause, text, 600)).alias("short_md5"),
        F.md5(prompts.prompt_text(clause, text, 2500)).alias("long_md5"),
    )


@query("prompt_skew", f"""SELECT clause_type, count(*) AS rows,
    count(*) FILTER (WHERE prompt <> {prompt("clause_type", "substr(contract_text, 1, 2500)")})
    AS mismatches FROM formatted GROUP BY clause_type""")
def _(t: Tables):
    served = t.samples.select(
        "sample_id",
        prompts.prompt_text(F.col("clause_type"), F.col("contract_text"), 2500).alias("prompt"),
    )
    return prompts.prompt_skew(t.formatted, served, "sample_id", "clause_type")


@query("input_gate", f"""SELECT doc_id, length({strip("text")}) AS chars FROM documents
    WHERE length({strip("text")}) >= 20""")
def _(t: Tables):
    return t.documents.where(prompts.accepts_input(F.col("text"))).select(
        "doc_id", F.length(strip_text(F.col("text"))).cast("bigint").alias("chars")
    )


@query("judge_prompts", f"""SELECT sample_id, model_tag, md5({template(
    fixed.JUDGE_TEMPLATE, contract_text="substr(contract_text, 1, 800)",
    clause_type="clause_type", reference="reference", prediction="prediction")}) AS prompt_md5
    FROM preds""")
def _(t: Tables):
    made = prompts.judge_prompt(
        F.col("contract_text"), F.col("clause_type"), F.col("reference"), F.col("prediction")
    )
    return t.predictions.select("sample_id", "model_tag", F.md5(made).alias("prompt_md5"))


_shown = "CASE WHEN {0} = '' THEN '(empty)' ELSE {0} END"


@query("pair_judge_prompts", f"""SELECT sample_id, model_tag, md5({template(
    fixed.PAIR_JUDGE_TEMPLATE, contract_text="substr(contract_text, 1, 1500)",
    clause_type="clause_type", output_a=_shown.format("reference"),
    output_b=_shown.format("prediction"))}) AS prompt_md5 FROM preds""")
def _(t: Tables):
    made = prompts.pair_judge_prompt(
        F.col("contract_text"), F.col("clause_type"), F.col("reference"), F.col("prediction")
    )
    return t.predictions.select("sample_id", "model_tag", F.md5(made).alias("prompt_md5"))


# --- near-duplicates --------------------------------------------------------------------


def token_sql(stratum: str = "lang") -> str:
    return f"""sets AS (SELECT doc_id AS id, {stratum} AS s,
        list_sort(list_distinct({words("lower(text)")})) AS t FROM documents)"""


def pair_sql(stratum: str = "lang") -> str:
    return token_sql(stratum) + """,
    tk AS MATERIALIZED (SELECT id, s, len(t) AS n, unnest(t) AS w FROM sets),
    shared AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.n AS na, b.n AS nb, count(*) AS c
        FROM tk a JOIN tk b ON a.s = b.s AND a.w = b.w AND a.id < b.id
        AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 0.000001 GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT i, j, c::DOUBLE / (na + nb - c) AS sim FROM shared
        WHERE c::DOUBLE / (na + nb - c) >= 0.85::DOUBLE),
    later AS MATERIALIZED (SELECT j AS id, list(i) AS earlier, row_number() OVER (ORDER BY j) AS k
        FROM pairs GROUP BY j),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
        SELECT l.k, CASE WHEN len(list_filter(l.earlier, lambda x: NOT list_contains(w.gone, x))) > 0
            THEN list_append(w.gone, l.id) ELSE w.gone END
        FROM walk w JOIN later l ON l.k = w.k + 1),
    lost AS MATERIALIZED (SELECT unnest(gone) AS id FROM walk WHERE k = (SELECT max(k) FROM walk))"""


@query("token_sets", token_sql() + """ == SELECT id, s AS stratum, len(t)::BIGINT AS size,
    md5(array_to_string(t, ' ')) AS set_key FROM sets""")
def _(t: Tables):
    return dedup.token_sets(t.documents, "doc_id", "lang", "text").select(
        "id", "stratum", F.size("tokens").cast("bigint").alias("size"), "set_key"
    )


SIGNATURES = token_sql() + f""",
    hashed AS (SELECT id, s, h FROM (SELECT id, s, unnest(t) AS w FROM sets),
        LATERAL (SELECT {d(42, "word", "w")} AS h)),
    perms AS (SELECT i, {d(42, "slope", "i")} % 1073741824 + 1 AS a, {d(42, "shift", "i")} AS b
        FROM range(128) r(i)),
    least_values AS (SELECT id, s, i, min((a * h + b) % 4294967311) AS v
        FROM hashed, perms GROUP BY id, s, i)"""


@query("minhash_signatures", SIGNATURES + """ == SELECT id,
    md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS signature_md5 FROM least_values GROUP BY id""")
def _(t: Tables):
    sets = dedup.token_sets(t.documents, "doc_id", "lang", "text")
    signed = dedup.minhash_signatures(sets)
    return signed.select(
        "id",
        F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature_md5"),
    )


@query("minhash_candidates", SIGNATURES + """,
    bands AS (SELECT id, s, i // 6 AS band, string_agg(v::VARCHAR, ',' ORDER BY i) AS k
        FROM least_values WHERE i < 120 GROUP BY id, s, i // 6),
    firsts AS (SELECT id, min(id) OVER (PARTITION BY s, band, k) AS c FROM bands)
    == SELECT id, min(c) AS candidate FROM firsts WHERE c < id GROUP BY id""")
def _(t: Tables):
    sets = dedup.token_sets(t.documents, "doc_id", "lang", "text")
    entries = materialize(dedup.band_blocks(dedup.minhash_signatures(sets)), "bands")
    return dedup.first_candidates(entries)


@query("near_duplicates", pair_sql() + """ == SELECT j AS doc_id, min(i) AS kept_id,
    round(arg_min(sim, i), 4) AS similarity FROM pairs
    WHERE j IN (SELECT id FROM lost) AND i NOT IN (SELECT id FROM lost) GROUP BY j""")
def _(t: Tables):
    return dedup.duplicate_links(t.documents, "doc_id", "lang", "text").select(
        "doc_id", "kept_id", r4("similarity")
    )


@query("keep_first", pair_sql() + """ == SELECT doc_id, lang, md5(text) AS text_md5
    FROM documents WHERE doc_id NOT IN (SELECT id FROM lost)""")
def _(t: Tables):
    return dedup.deduplicate(t.documents, "doc_id", "lang", "text").select(
        "doc_id", "lang", F.md5("text").alias("text_md5")
    )


@query("incremental_dedup", pair_sql() + """ == SELECT doc_id FROM documents
    WHERE doc_id NOT IN (SELECT id FROM lost)""")
def _(t: Tables):
    path = scratch_path(t.spark, "dedup-index")
    half = (t.documents.agg(F.max("doc_id")).first()[0] or 0) // 2
    for batch in (F.col("doc_id") <= half, F.col("doc_id") > half):
        dedup_index.append_batch(path, t.documents.where(batch), "doc_id", "lang", "text")
    return dedup_index.kept_rows(t.spark, path).select(F.col("id").alias("doc_id"))


COMPONENTS = pair_sql() + """,
    reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION
        SELECT e.j, r.root FROM reach r JOIN (SELECT i, j FROM pairs UNION ALL
            SELECT j, i FROM pairs) e ON e.i = r.id),
    components AS MATERIALIZED (SELECT id AS doc_id, min(root) AS component FROM reach GROUP BY id)"""


@query("similar_components", COMPONENTS + " == SELECT doc_id, component FROM components")
def _(t: Tables):
    return dedup.similar_components(t.documents, "doc_id", "lang", "text")


@query("leak_free_split", COMPONENTS + """,
    units AS (SELECT component, count(*) AS size, arg_min(source, doc_id) AS s,
        md5('42|unit|c' || component) AS k FROM components JOIN documents USING (doc_id)
        GROUP BY component),
    quotas AS (SELECT s, greatest(1, floor(sum(size) * 0.15::DOUBLE)) AS test,
        greatest(1, floor(sum(size) * 0.1::DOUBLE)) AS val FROM units GROUP BY s),
    small AS (SELECT component, u.s, test, val, sum(size) OVER (PARTITION BY u.s ORDER BY k)
        - size AS before FROM units u JOIN quotas q ON u.s = q.s WHERE size <= least(test, val)),
    turns AS (SELECT *, min(CASE WHEN before >= test THEN before END) OVER (PARTITION BY s) AS turn
        FROM small)
    == SELECT doc_id, source, component, CASE WHEN before < test THEN 'test'
        WHEN before < turn + val THEN 'val' ELSE 'train' END AS split
    FROM components JOIN documents USING (doc_id) LEFT JOIN turns USING (component)""")
def _(t: Tables):
    grouped = dedup.similar_components(t.documents, "doc_id", "lang", "text")
    rows = t.documents.select("doc_id", "source").join(grouped, "doc_id")
    return sampling.leak_free_split(rows, "doc_id", "source", "component")


@query("keep_first_minhash", pair_sql("source") + """ == SELECT doc_id
    FROM documents WHERE doc_id NOT IN (SELECT id FROM lost)""")
def _(t: Tables):
    return dedup.kept_ids(
        t.documents, "doc_id", "source", "text",
        blocks=lambda sets: dedup.band_blocks(dedup.minhash_signatures(sets)),
    )


@query("dedup_report", pair_sql() + """,
    flags AS (SELECT lang, doc_id NOT IN (SELECT id FROM lost) AS kept FROM documents)
    == SELECT lang, grouping(lang)::BIGINT AS total, count(*) AS rows,
    count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS removed
    FROM flags GROUP BY GROUPING SETS ((lang), ())""")
def _(t: Tables):
    flags = dedup.flag_duplicates(t.documents, "doc_id", "lang", "text")
    return dedup.dedup_report(flags, "lang")


# --- perplexity -------------------------------------------------------------------------


UNIGRAMS = f"""tk AS (SELECT doc_id, unnest({words("lower(text)")}) AS token FROM documents),
    freq AS (SELECT token, count(*) AS count FROM tk GROUP BY token),
    lp AS (SELECT token, count, ln(count::DOUBLE / (SELECT sum(count) FROM freq) + 1e-10)
        AS log_prob FROM freq)"""
PERPLEXITY = UNIGRAMS + f""",
    sums AS (SELECT doc_id, count(*) AS n_tokens,
        sum(round(log_prob * 10000000000)::BIGINT)::BIGINT AS units
        FROM tk JOIN lp USING (token) GROUP BY doc_id),
    ppl AS (SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, CASE WHEN n_tokens >= 10 THEN
        round(exp(-units / (n_tokens * 10000000000.0::DOUBLE)) * 10000)::BIGINT END AS ppl_key
        FROM documents d LEFT JOIN sums USING (doc_id)),
    band AS (SELECT quantile_cont(ppl_key, 0.05) AS lo, quantile_cont(ppl_key, 0.95) AS hi
        FROM ppl WHERE ppl_key IS NOT NULL),
    flags AS (SELECT ppl.*, coalesce(ppl_key BETWEEN lo AND hi, false)
        OR (SELECT count(*) FROM ppl) < 20 AS kept FROM ppl, band)"""


@query("unigram_table", UNIGRAMS + " == SELECT token, count FROM freq")
def _(t: Tables):
    return perplexity.unigram_table(t.documents, "text")


@query("unigram_log_prob", UNIGRAMS + " == SELECT token, round(log_prob, 6) AS log_prob FROM lp")
def _(t: Tables):
    table = perplexity.unigram_table(t.documents, "text")
    return perplexity.log_probabilities(table).select(
        "token", F.round("log_prob", 6).alias("log_prob")
    )


@query("perplexity", PERPLEXITY + " == SELECT doc_id, n_tokens, ppl_key FROM ppl")
def _(t: Tables):
    return perplexity.perplexities(t.documents, "doc_id", "text").select(
        "doc_id", "n_tokens", "ppl_key"
    )


@query("perplexity_large_vocabulary", PERPLEXITY + " == SELECT doc_id, n_tokens, ppl_key FROM ppl")
def _(t: Tables):
    return perplexity.perplexities(t.documents, "doc_id", "text", vocabulary_rows=0).select(
        "doc_id", "n_tokens", "ppl_key"
    )


def scored(t: Tables):
    return materialize(perplexity.perplexities(t.documents, "doc_id", "text"), "perplexities")


@query("perplexity_band", PERPLEXITY + """ == SELECT round(lo / 10000, 4) AS lo,
    round(hi / 10000, 4) AS hi FROM band""")
def _(t: Tables):
    return perplexity.perplexity_band(scored(t)).select(r4("lo"), r4("hi"))


@query("perplexity_filter", PERPLEXITY + """ == SELECT doc_id, md5(text) AS text_md5
    FROM documents WHERE doc_id IN (SELECT doc_id FROM flags WHERE kept)""")
def _(t: Tables):
    return perplexity.filter_by_perplexity(t.documents, "doc_id", "text").select(
        "doc_id", F.md5("text").alias("text_md5")
    )


@query("perplexity_pass_through", PERPLEXITY + " == SELECT doc_id FROM ppl")
def _(t: Tables):
    # The same rule with a row minimum above the table's size: nothing is dropped.
    rows = scored(t)
    return perplexity.flag_by_perplexity(rows, min_rows=2**62).where("kept").select("doc_id")


@query("perplexity_report", PERPLEXITY + """ == SELECT count(*) FILTER (WHERE kept) AS kept,
    count(*) AS total, (SELECT round(lo / 10000, 4) FROM band) AS lo,
    (SELECT round(hi / 10000, 4) FROM band) AS hi FROM flags""")
def _(t: Tables):
    rows = scored(t)
    report = perplexity.perplexity_report(
        perplexity.flag_by_perplexity(rows), perplexity.perplexity_band(rows)
    )
    return report.select("kept", "total", r4("lo"), r4("hi"))


# --- splits and samples -----------------------------------------------------------------


@query("stratified_split", SPLIT_CTE + "== SELECT sample_id, clause_type, split FROM split_rows")
def _(t: Tables):
    return split_rows(t).select("sample_id", "clause_type", "split")


@query("stratified_split_by_source", """ranked AS (SELECT doc_id, source, row_number() OVER (
    PARTITION BY source ORDER BY md5('42|split|' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY source) AS n FROM documents)
    == SELECT doc_id, source, CASE WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'test'
    WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE))
    THEN 'val' ELSE 'train' END AS split FROM ranked""")
def _(t: Tables):
    return sampling.stratified_split(t.documents, "doc_id", "source").select(
        "doc_id", "source", "split"
    )


@query("eval_sample", """SELECT sample_id, clause_type FROM samples
    ORDER BY md5('42|sample|' || sample_id), sample_id LIMIT 120""")
def _(t: Tables):
    return sampling.seeded_sample(
        t.samples.select("sample_id", "clause_type"), "sample_id", fixed.EVAL_SAMPLES
    )


@query("judge_sample", """SELECT sample_id FROM samples
    ORDER BY md5('42|sample|' || sample_id), sample_id LIMIT 50""")
def _(t: Tables):
    return sampling.seeded_sample(
        t.samples.select("sample_id"), "sample_id", fixed.JUDGE_SAMPLES
    )


@query("prefix_sample", "SELECT sample_id FROM samples ORDER BY sample_id LIMIT 40")
def _(t: Tables):
    return sampling.first_rows(
        t.samples.select("sample_id"), "sample_id", fixed.CALIBRATION_SAMPLES
    )


@query("recombine_splits", SPLIT_CTE + "== SELECT sample_id, split FROM split_rows")
def _(t: Tables):
    rows = materialize(split_rows(t).select("sample_id", "split"), "splits")
    parts = {s: rows.where(F.col("split") == s).drop("split") for s in io.SPLITS}
    return sampling.recombine(parts)


# --- preference pairs -------------------------------------------------------------------


YEARS = "\\b20\\d{2}\\b"
PARTIES = "\\b[A-Z][a-z]+ (?:Inc\\.|LLC|Corp\\.|Ltd\\.|Co\\.)"


def swap(text: str, pattern: str, salt: str, options: list[str]) -> str:
    pieces = f"regexp_split_to_array({text}, '{pattern}')"
    choice = "([" + ", ".join(map(lit, options)) + "])"
    return f"""array_to_string(list_transform({pieces}, lambda x, i: CASE WHEN i = 1 THEN x
        ELSE {choice}[{d(42, salt, "sample_id", "(i - 1)")} % 4 + 1] || x END), '')"""


PAIRS = f"""drawn AS (SELECT *, (['truncate', 'hallucinate', 'wrong_clause'])[
        {d(42, "strategy", "sample_id")} % 3 + 1] AS strategy, {n_words("answer")} AS n
        FROM formatted WHERE answer <> '' AND answer NOT LIKE 'No %'),
    names AS (SELECT list(clause_type ORDER BY clause_type) AS all_names
        FROM (SELECT DISTINCT clause_type FROM samples)),
    numbered AS (SELECT clause_type, answer, row_number() OVER (PARTITION BY clause_type
        ORDER BY md5('42|answers|' || sample_id), sample_id) - 1 AS idx,
        count(*) OVER (PARTITION BY clause_type) AS cnt FROM samples),
    sizes AS (SELECT DISTINCT clause_type, cnt FROM numbered),
    asked AS (SELECT sample_id, list_filter(all_names, lambda c: c <> clause_type) AS others
        FROM drawn, names WHERE strategy = 'wrong_clause'),
    targeted AS (SELECT sample_id, others[({d(42, "class", "sample_id")} % greatest(len(others), 1) + 1)::INT]
        AS other FROM asked),
    wrong AS (SELECT a.sample_id, m.answer FROM targeted a JOIN sizes s ON s.clause_type = a.other
        JOIN numbered m ON m.clause_type = a.other AND m.idx = {d(42, "answer", "a.sample_id")} % s.cnt),
    swapped AS (SELECT sample_id, {swap("answer", YEARS, "year", fixed.FAKE_YEARS)} AS answer FROM drawn),
    pairs AS (SELECT sample_id, strategy, prompt, d.answer AS chosen, CASE strategy
        WHEN 'truncate' THEN CASE WHEN n > 10 THEN {first("d.answer", f'''(n // 4 +
            {d(42, "cut", "sample_id")} % (n // 2 - n // 4 + 1))''')} || '... [incomplete]'
            ELSE 'No relevant clause found.' END
        WHEN 'hallucinate' THEN (SELECT {swap("s.answer", PARTIES, "party", fixed.FAKE_PARTIES)}
            FROM swapped s WHERE s.sample_id = d.sample_id)
        ELSE coalesce((SELECT w.answer FROM wrong w WHERE w.sample_id = d.sample_id),
            'This clause is not present in the agreement.') END AS rejected FROM drawn d)"""


def pairs(t: Tables):
    return preference.preference_pairs(t.formatted, "sample_id")


@query("pair_eligible", "SELECT sample_id FROM samples WHERE answer <> '' AND answer NOT LIKE 'No %'")
def _(t: Tables):
    return t.samples.where(preference.is_eligible(F.col("answer"))).select("sample_id")


@query("pair_strategy", f"""SELECT sample_id, (['truncate', 'hallucinate', 'wrong_clause'])[
    {d(42, "strategy", "sample_id")} % 3 + 1] AS strategy FROM samples""")
def _(t: Tables):
    return t.samples.select(
        "sample_id", preference.strategy(F.col("sample_id")).alias("strategy")
    )


@query("pair_truncate", PAIRS + """ == SELECT sample_id, rejected FROM pairs
    WHERE strategy = 'truncate'""")
def _(t: Tables):
    rows = t.samples.where(preference.is_eligible(F.col("answer"))).where(
        preference.strategy(F.col("sample_id")) == "truncate"
    )
    return rows.select(
        "sample_id", preference.truncated(F.col("answer"), F.col("sample_id")).alias("rejected")
    )


@query("pair_entity_swap", f"""swapped AS (SELECT sample_id,
    {swap("answer", YEARS, "year", fixed.FAKE_YEARS)} AS answer FROM samples)
    == SELECT sample_id, {swap("answer", PARTIES, "party", fixed.FAKE_PARTIES)} AS swapped
    FROM swapped""")
def _(t: Tables):
    return t.samples.select(
        "sample_id",
        preference.swap_entities(F.col("answer"), F.col("sample_id")).alias("swapped"),
    )


@query("pair_wrong_class", PAIRS + """ == SELECT sample_id, rejected FROM pairs
    WHERE strategy = 'wrong_clause'""")
def _(t: Tables):
    return pairs(t).where(F.col("strategy") == "wrong_clause").select("sample_id", "rejected")


@query("preference_pairs", PAIRS + """ == SELECT sample_id, strategy, md5(prompt) AS prompt_md5,
    chosen, rejected FROM pairs""")
def _(t: Tables):
    return pairs(t).select(
        "sample_id", "strategy", F.md5("prompt").alias("prompt_md5"), "chosen", "rejected"
    )


VAL_PAIRS = (SPLIT_CTE + ", val_rows AS (SELECT sample_id, clause_type, prompt, answer"
             " FROM split_rows WHERE split = 'val'), "
             + PAIRS.replace("FROM formatted", "FROM val_rows").replace("FROM samples", "FROM val_rows"))


@query("validation_pairs", VAL_PAIRS + """ == SELECT sample_id, strategy, md5(prompt) AS prompt_md5,
    chosen, rejected FROM pairs""")
def _(t: Tables):
    return validation_pairs(split_rows(t)).select(
        "sample_id", "strategy", F.md5("prompt").alias("prompt_md5"), "chosen", "rejected"
    )


@query("pair_report", PAIRS + """ == SELECT strategy, count(*) AS pairs,
    round(count(*) / (SELECT count(*) FROM pairs), 4) AS share,
    round(avg((rejected = chosen)::INT), 4) AS unchanged_share FROM pairs GROUP BY strategy""")
def _(t: Tables):
    return preference.pair_report(pairs(t)).select(
        "strategy", "pairs", r4("share"), r4("unchanged_share")
    )
