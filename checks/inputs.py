"""Inputs that both engines derive from the given tables.

The tables hold documents, labels, conversations and embeddings, but no questions,
answers, predictions or replies. Those follow from the documents and from repeatable
draws, in Spark below and in SQL in ``CTES``; every row of a table is used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.draws import draw
from quillmill.functions.text import SPACE_CLASS as SPACE
from quillmill.functions.text import first_words
from quillmill.operators.curate import flatten_qa
from quillmill.operators.prompts import format_as_instruction
from quillmill.session import materialize
from quillmill.sources.io import read_table

QUESTIONS = [
    *['Highlight the parts related to "Governing Law" for review.'] * 6,
    *['Which parts concern "Anti-Assignment"?'] * 3,
    "Is there an ASSIGNMENT clause?",
    'What does "IP Ownership Assignment" say?',
    "  Any Intellectual Property terms? ",
    "Audit Rights",
    "Termination for Convenience",
    "Change of Control",
    "Non-Compete, and for how long?",
    "Most Favored Nation",
    "Limitation of Liability and Indemnification",
    "Renewal term and price",
    None,
]
ENTITIES = " Acme Inc. signed in 2015 and 2031 with Bolt Corp. and Acme LLC, not in 1999 or 20155."
TAGS = ["base", "qlora", "dpo"]
NOT_FOUND = "The clause was not found in this text! It is not here at all."

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


class Tables:
    """The given tables and what is derived from them, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(
            self.spark, f"{self.sf_dir}/{name}.parquet", SCHEMAS[name],
            spread=name in ("documents", "embeddings"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @cached_property
    def qa(self) -> DataFrame:
        """(sample_id, context, question, answers.text)"""
        i = F.col("doc_id")
        asked = F.get(
            F.array(*[F.lit(q) for q in QUESTIONS]),
            (draw(7, "question", i) % len(QUESTIONS)).cast("int"),
        )
        line = F.substring_index(F.col("text"), "\n", 1)
        kind = draw(7, "answer", i) % 8
        answers = (
            F.when(kind == 0, F.array().cast("array<string>"))
            .when(kind == 1, F.array(F.lit("")))
            .when(kind == 2, F.array(F.concat(F.lit("No such clause in "), F.col("lang")), line))
            .when(kind == 3, F.array(F.concat(line, F.lit(ENTITIES))))
            .otherwise(F.array(line, F.lit("second answer")))
        )
        return self.documents.select(
            i.alias("sample_id"), F.col("text").alias("context"), asked.alias("question"),
            F.struct(answers.alias("text")).alias("answers"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return materialize(flatten_qa(self.qa), "samples")

    @cached_property
    def formatted(self) -> DataFrame:
        return format_as_instruction(self.samples)

    @cached_property
    def predictions(self) -> DataFrame:
        """One row per sample and model: texts, scores, token log-probabilities, latency."""
        tag, i = F.col("model_tag"), F.col("sample_id")
        kind = draw(11, "edit", tag, i) % 6
        prediction = (
            F.when(kind == 0, F.col("answer"))
            .when(kind == 1, F.concat(
                first_words(F.col("answer"), 3), F.lit(fixed.INCOMPLETE_MARKER)))
            .when(kind == 2, F.concat(F.lit("No "), F.col("clause_type"), F.lit(" clause found.")))
            .when(kind == 3, F.concat_ws(
                " ", F.col("answer"), F.col("answer"), first_words(F.col("contract_text"), 40)))
            .when(kind == 4, F.lit(NOT_FOUND))
            .otherwise(F.lit("Not present!"))
        )

        def unit(salt: str, *more: Column) -> Column:
            return draw(11, salt, tag, i, *more) / F.lit(4294967296.0)

        steps = (draw(11, "steps", tag, i) % 6).cast("int")
        log_probs = F.when(steps == 0, F.array().cast("array<double>")).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
            lambda k: F.when(draw(11, "sure", tag, i) % 13 == 0, F.lit(0.0)).otherwise(
                -unit("step", k) / 2),
        ))
        rows = self.formatted.withColumn(
            "model_tag", F.explode(F.array(*[F.lit(t) for t in TAGS]))
        )
        scored = rows.select(
            "sample_id", "model_tag", "clause_type", "contract_text", "prompt",
            F.col("answer").alias("reference"), prediction.alias("prediction"),
            unit("precision").alias("precision"), unit("recall").alias("recall"),
            log_probs.alias("log_probs"),
            (draw(11, "latency", tag, i) % 2000).alias("latency_ms"),
        ).withColumn(
            "f1",
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
        )
        return scored.withColumn(
            "bertscore_f1",
            F.when(draw(11, "unscored", tag, i) % 17 != 0, F.round("f1", 4)),
        )

    @cached_property
    def stored_predictions(self) -> DataFrame:
        return materialize(self.predictions, "predictions")

    @cached_property
    def replies(self) -> DataFrame:
        """Judge replies, one per prediction, well and badly formed."""
        tag, i = F.col("model_tag"), F.col("sample_id")

        def mark(salt: str) -> Column:
            return (draw(13, salt, tag, i) % 11).cast("string")

        f, c, p = mark("f"), mark("c"), mark("p")

        def text(*parts) -> Column:
            return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

        full = text('{"faithfulness": ', f, ', "completeness": ', c, ', "precision": ', p, "}")
        kind = draw(13, "kind", tag, i) % 9
        reply = (
            F.when(kind == 0, full)
            .when(kind == 1, text("Sure, here it is:\n", full, "\nDone."))
            .when(kind == 2, text('{"faithfulness": ', f, ', "precision": ', p, "}"))
            .when(kind == 3, F.lit("I cannot score this."))
            .when(kind == 4, text('{"faithfulness": "', f, '", "completeness": ', c, "}"))
            .when(kind == 5, text(
                '{"faithfulness": ', f, ', "completeness": "high", "precision": ', p, "}"))
            .when(kind == 6, text('{"faithfulness": ', f, ', "completeness": }'))
            .when(kind == 7, text('{"faithfulness": null, "completeness": ', c, "}"))
            .otherwise(text(full, " or ", full))
        )
        pair = F.when(kind == 3, F.lit("No scores.")).otherwise(text(
            'Scores: {"A": ', full, ', "B": {"faithfulness": ', c,
            F.when(kind == 2, F.lit("")).otherwise(text(', "precision": "', p, '"')), "}}"))
        made = self.predictions.select(
            "sample_id", "model_tag", reply.alias("reply"), pair.alias("pair_reply")
        )
        return materialize(made, "replies")

    @cached_property
    def clustered(self) -> DataFrame:
        """Failures of one model with a drawn cluster and map position."""
        i = F.col("sample_id")
        made = self.predictions.where(F.col("model_tag") == "dpo").where(
            F.coalesce("bertscore_f1", F.lit(1.0)) < fixed.FAILURE_F1
        ).select(
            "sample_id", "clause_type", "prediction", "reference",
            (draw(17, "cluster", i) % 7 - 1).alias("cluster_id"),
            (draw(17, "x", i) / F.lit(4294967296.0)).alias("x"),
            (draw(17, "y", i) / F.lit(4294967296.0)).alias("y"),
        )
        return materialize(made, "clustered")


# --- the same in SQL --------------------------------------------------------------------


def d(seed: int, salt: str, *ids: str) -> str:
    joined = " || '|' || ".join(ids)
    return f"('0x' || substr(md5('{seed}|{salt}|' || {joined}), 1, 8))::BIGINT"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})::BIGINT"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def first(x: str, n: int | str) -> str:
    return f"array_to_string(list_slice({words(x)}, 1, {n}), ' ')"


def lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def classify(x: str) -> str:
    whens = " ".join(
        f"WHEN contains({x}, {lit(k)}) THEN {lit(v)}" for k, v in fixed.CLAUSE_KEYWORDS
    )
    return f"CASE {whens} ELSE 'Other' END"


def template(text: str, **fields: str) -> str:
    """SQL concatenation for a template, from its literal text and its fields."""
    out = lit(text)
    for name, expr in fields.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return f"({out})"


SYSTEM_TURN = lit(
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
    + fixed.SYSTEM_PROMPT + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
)
ASSISTANT = lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")


def prompt(clause: str, text: str) -> str:
    body = template(fixed.INSTRUCTION_TEMPLATE, clause_type=clause, contract_text=text)
    return f"({SYSTEM_TURN} || {body} || {ASSISTANT})"


_targets = ", ".join(lit(t) for t in fixed.TARGET_CLAUSES)
_questions = ", ".join(lit(q) for q in QUESTIONS)
_unit = "/ 4294967296.0::DOUBLE"
_full = """'{"faithfulness": ' || f || ', "completeness": ' || c || ', "precision": ' || p || '}'"""

CTES = f"""
qa AS (
  SELECT doc_id AS sample_id, text AS context,
    ([{_questions}])[{d(7, "question", "doc_id")} % {len(QUESTIONS)} + 1] AS question,
    CASE {d(7, "answer", "doc_id")} % 8
      WHEN 0 THEN []::VARCHAR[]
      WHEN 1 THEN ['']
      WHEN 2 THEN ['No such clause in ' || lang, split_part(text, chr(10), 1)]
      WHEN 3 THEN [split_part(text, chr(10), 1) || {lit(ENTITIES)}]
      ELSE [split_part(text, chr(10), 1), 'second answer'] END AS answers
  FROM documents),
tagged AS (
  SELECT *, {classify("lower(coalesce(question, ''))")} AS clause_type,
    {n_words("context")} AS context_words
  FROM qa),
cut AS (
  SELECT sample_id, clause_type,
    CASE WHEN context_words > 800 THEN {first("context", 800)} || ' [...]'
      ELSE {strip("context")} END AS contract_text,
    {strip("CASE WHEN len(answers) > 0 THEN answers[1] ELSE 'No clause found.' END")} AS answer,
    {strip("coalesce(question, '')")} AS question
  FROM tagged WHERE context_words >= 50 AND clause_type IN ({_targets})),
samples AS (SELECT *, {n_words("contract_text")} AS source_length FROM cut),
formatted AS (
  SELECT *, {prompt("clause_type", "contract_text")} AS prompt,
    {prompt("clause_type", "contract_text")} || answer || '<|eot_id|>' AS text
  FROM samples),
tags AS (SELECT unnest({TAGS}) AS model_tag),
edited AS (
  SELECT s.*, t.model_tag, s.answer AS reference,
    CASE {d(11, "edit", "model_tag", "sample_id")} % 6
      WHEN 0 THEN answer
      WHEN 1 THEN {first("answer", 3)} || '... [incomplete]'
      WHEN 2 THEN 'No ' || clause_type || ' clause found.'
      WHEN 3 THEN answer || ' ' || answer || ' ' || {first("contract_text", 40)}
      WHEN 4 THEN {lit(NOT_FOUND)}
      ELSE 'Not present!' END AS prediction,
    {d(11, "precision", "model_tag", "sample_id")} {_unit} AS precision,
    {d(11, "recall", "model_tag", "sample_id")} {_unit} AS recall,
    list_transform(range(1, {d(11, "steps", "model_tag", "sample_id")} % 6 + 1), lambda k:
      CASE WHEN {d(11, "sure", "model_tag", "sample_id")} % 13 = 0 THEN 0.0::DOUBLE
        ELSE -({d(11, "step", "model_tag", "sample_id", "k")} {_unit}) / 2 END) AS log_probs,
    {d(11, "latency", "model_tag", "sample_id")} % 2000 AS latency_ms
  FROM formatted s, tags t),
preds AS (
  SELECT *, 2 * precision * recall / (precision + recall) AS f1,
    CASE WHEN {d(11, "unscored", "model_tag", "sample_id")} % 17 <> 0
      THEN round(2 * precision * recall / (precision + recall), 4) END AS bertscore_f1
  FROM edited),
marks AS (
  SELECT sample_id, model_tag, {d(13, "kind", "model_tag", "sample_id")} % 9 AS kind,
    ({d(13, "f", "model_tag", "sample_id")} % 11)::VARCHAR AS f,
    ({d(13, "c", "model_tag", "sample_id")} % 11)::VARCHAR AS c,
    ({d(13, "p", "model_tag", "sample_id")} % 11)::VARCHAR AS p
  FROM edited),
replies AS (
  SELECT sample_id, model_tag, CASE kind
      WHEN 0 THEN {_full}
      WHEN 1 THEN 'Sure, here it is:' || chr(10) || {_full} || chr(10) || 'Done.'
      WHEN 2 THEN '{{"faithfulness": ' || f || ', "precision": ' || p || '}}'
      WHEN 3 THEN 'I cannot score this.'
      WHEN 4 THEN '{{"faithfulness": "' || f || '", "completeness": ' || c || '}}'
      WHEN 5 THEN '{{"faithfulness": ' || f || ', "completeness": "high", "precision": ' || p || '}}'
      WHEN 6 THEN '{{"faithfulness": ' || f || ', "completeness": }}'
      WHEN 7 THEN '{{"faithfulness": null, "completeness": ' || c || '}}'
      ELSE {_full} || ' or ' || {_full} END AS reply,
    CASE WHEN kind = 3 THEN 'No scores.' ELSE
      'Scores: {{"A": ' || {_full} || ', "B": {{"faithfulness": ' || c ||
      CASE WHEN kind = 2 THEN '' ELSE ', "precision": "' || p || '"' END || '}}}}' END AS pair_reply
  FROM marks),
clustered AS (
  SELECT sample_id, clause_type, prediction, reference,
    {d(17, "cluster", "sample_id")} % 7 - 1 AS cluster_id,
    {d(17, "x", "sample_id")} {_unit} AS x, {d(17, "y", "sample_id")} {_unit} AS y
  FROM preds WHERE model_tag = 'dpo' AND coalesce(bertscore_f1, 1.0) < 0.65)
""".strip()
