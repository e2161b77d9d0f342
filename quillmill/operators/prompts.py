"""Prompt texts for training, serving and judging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import prefix, strip, text_or_empty


def fill(template: str, **fields: Column) -> Column:
    """Concatenate the template's text with columns for its {fields}.

    Replacing in turn would also replace braces inside the inserted documents.
    """
    names = "|".join(map(re.escape, fields))
    parts = re.split(rf"\{{({names})\}}", template)
    return F.concat(*[
        text_or_empty(fields[part]) if i % 2 else F.lit(part) for i, part in enumerate(parts)
    ])


def chat_turn(role: Column | str, content: Column) -> Column:
    who = F.lit(role) if isinstance(role, str) else role
    return F.concat(
        F.lit(fixed.ROLE_OPEN), who, F.lit(fixed.ROLE_CLOSE), text_or_empty(content),
        F.lit(fixed.TURN_END),
    )


def generation_header() -> Column:
    return F.lit(f"{fixed.ROLE_OPEN}assistant{fixed.ROLE_CLOSE}")


def instruction(clause_type: Column, contract_text: Column) -> Column:
    return fill(
        fixed.INSTRUCTION_TEMPLATE, clause_type=clause_type, contract_text=contract_text
    )


def prompt_text(
    clause_type: Column,
    contract_text: Column,
    char_budget: int | None = None,
    system: str = fixed.SYSTEM_PROMPT,
) -> Column:
    """System and user turn plus the open assistant turn; a budget cuts the contract."""
    excerpt = contract_text if char_budget is None else prefix(contract_text, char_budget)
    return F.concat(
        F.lit(fixed.BEGIN_TEXT),
        chat_turn("system", F.lit(system)),
        chat_turn("user", instruction(clause_type, excerpt)),
        generation_header(),
    )


def format_as_instruction(samples: DataFrame) -> DataFrame:
    """Adds ``prompt`` (for inference) and ``text`` (with the answer, for training)."""
    prompt = prompt_text(F.col("clause_type"), F.col("contract_text"))
    answer = F.concat(text_or_empty(F.col("answer")), F.lit(fixed.TURN_END))
    return samples.withColumn("prompt", prompt).withColumn(
        "text", F.concat(F.col("prompt"), answer)
    )


def chat_texts(
    messages: DataFrame,
    id_col: str,
    turn_col: str = "turn",
    add_generation_prompt: bool = False,
) -> DataFrame:
    """One chat text per conversation from a long table (id, turn, role, content).

    A conversation is one output value, so its turns must meet in one row anyway.
    """
    turns = messages.select(
        id_col,
        F.struct(F.col(turn_col), chat_turn(F.col("role"), F.col("content")).alias("turn_text"))
        .alias("t"),
    )
    joined = turns.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    body = F.array_join(F.col("ts.turn_text"), "")
    tail = generation_header() if add_generation_prompt else F.lit("")
    return joined.select(id_col, F.concat(F.lit(fixed.BEGIN_TEXT), body, tail).alias("text"))


def prompt_skew(training: DataFrame, serving: DataFrame, id_col: str, stratum: str) -> DataFrame:
    """Per stratum, the rows whose training and serving prompt differ by a byte.

    Prompts are digested before the join, so digests and not texts are shuffled.
    """
    left = training.select(id_col, stratum, F.sha2("prompt", 256).alias("_train"))
    right = serving.select(id_col, F.sha2("prompt", 256).alias("_serve"))
    return (
        left.join(right, id_col)
        .groupBy(stratum)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("_train") != F.col("_serve")).alias("mismatches"),
        )
    )


def accepts_input(text: Column, min_chars: int = 20, trim: bool = True) -> Column:
    """The gate in front of the model: enough characters, spaces at the ends not counted."""
    return F.length(strip(text) if trim else text_or_empty(text)) >= min_chars


def judge_prompt(
    contract_text: Column,
    clause_type: Column,
    reference: Column,
    prediction: Column,
    contract_chars: int = 800,
) -> Column:
    return fill(
        fixed.JUDGE_TEMPLATE,
        contract_text=prefix(contract_text, contract_chars),
        clause_type=clause_type,
        reference=reference,
        prediction=prediction,
    )


def pair_judge_prompt(
    contract_text: Column,
    clause_type: Column,
    output_a: Column,
    output_b: Column,
    contract_chars: int = 1500,
) -> Column:
    def shown(output: Column) -> Column:
        known = text_or_empty(output)
        return F.when(known == "", fixed.EMPTY_OUTPUT).otherwise(known)

    return fill(
        fixed.PAIR_JUDGE_TEMPLATE,
        contract_text=prefix(contract_text, contract_chars),
        clause_type=clause_type,
        output_a=shown(output_a),
        output_b=shown(output_b),
    )
