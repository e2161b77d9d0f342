"""Personal data: pattern spans, and words that give protected values away by co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import whole_text, without
from quillmill.operators.scale import salted_join
from quillmill.session import materialize

#: The kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

# Matches are leftmost and do not overlap. Possessive quantifiers never give back what they
# took, which changes no match here and keeps the matcher iterative on very long runs. A run
# of word characters can only begin a match at its first one, or where the last match
# ended (\G), so a long run is scanned once and not once per position.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap conditions without which a text has no valid match, so that most texts are scanned once.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
WORD = r"[\p{L}\p{N}_]+"
BASE_TYPE = "array<struct<kind:string,s:int,e:int,v:string>>"
TERM_TYPE = "array<struct<s:int,e:int,by:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits pass the Luhn test."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(
            i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)
        ).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(value, r"\."), small)
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _spans(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as array<struct<s, e, v>>, in code points, end exclusive.

    Spark gives matches and the pieces between them, but no positions: a running sum over
    their lengths does. The fold appends to an array; a text has few matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["v"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e"),
                                                    m["v"].alias("v")))).alias("spans"),
        )

    zipped = F.zip_with(
        found, F.slice(pieces, F.lit(1), F.size(found)),
        lambda v, gap: F.struct(v.alias("v"), gap.alias("gap")),
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(zipped, start, add)["spans"]


def base_spans(text: Column) -> Column:
    """Valid base spans as array<struct<kind, s, e, v>>, by kind as listed, then start."""
    none = F.array().cast(BASE_TYPE)

    def of_kind(kind: str) -> Column:
        valid = F.filter(_spans(text, PATTERNS[kind]), lambda m: _valid(kind, m["v"]))
        tagged = F.transform(valid, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v")
        ))
        return F.when(F.regexp_like(text, F.lit(HINTS[kind])), tagged).otherwise(none)

    return F.concat(*[of_kind(k) for k in KINDS])


def _entity(kind: Column, value: Column) -> Column:
    """The protected value behind a span: case, blanks and punctuation do not tell two apart."""
    return F.concat(
        kind, F.lit(":"),
        F.when(kind == "email", F.lower(value)).when(kind == "ip", value)
        .otherwise(_digits(value)),
    )


def _part(kind: Column, value: Column) -> Column:
    """What many values share: mail domain, first three numbers of an address, first three
    digits of a telephone number, issuer of a card. A function of the entity, not of its
    spelling."""
    return F.concat(
        kind, F.lit("/"),
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.regexp_extract(value, r"^[0-9]+\.[0-9]+\.[0-9]+", 0))
        .when(kind == "phone", F.substring(_digits(value), 1, 3))
        .otherwise(F.substring(_digits(value), 1, 6)),
    )


def _occurrences(found: DataFrame) -> DataFrame:
    """(__key, word, s, e): the words of the whole texts that no base span touches."""
    gaps = F.transform(F.split("t", WORD, -1), F.length)
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    each = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)),
                      lambda v, gap: F.struct(v.alias("v"), gap.alias("gap")))
    so_far = Window.partitionBy("__key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("w.v")
    placed = found.select("__key", F.posexplode(each).alias("i", "w")).withColumn(
        "e", F.sum(F.col("w.gap") + length).over(so_far).cast("int")
    )
    base = found.select("__key", F.explode("base").alias("b"))
    both = placed.select("__key", F.lower("w.v").alias("word"), (F.col("e") - length).alias("s"), "e")
    both = both.unionByName(
        base.select("__key", F.lit(None).cast("string").alias("word"), "b.s", "b.e")
    )
    is_base = F.col("word").isNull()

    def up_to(order: Column) -> Window:
        return Window.partitionBy("__key").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)

    # Spans that begin earlier must have ended, those that begin later must not have begun.
    ended = F.max(F.when(is_base, F.col("e"))).over(up_to(F.col("s").asc()))
    begins = F.min(F.when(is_base, F.col("s"))).over(up_to(F.col("s").desc()))
    return (
        both.withColumn("ended", ended).withColumn("begins", begins)
        .where(~is_base & (F.coalesce("ended", "s") <= F.col("s"))
               & (F.coalesce("begins", "e") >= F.col("e")))
        .select("__key", "word", "s", "e")
    )


def _lower_share(j: Column, n: Column, z: float = 1.645) -> Column:
    """The lower end of the Wilson interval of j of n (one-sided, 95 % by default)."""
    p = j / n
    spread = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - z * spread) / (1 + z * z / n)


def disclosing_terms(
    docs: DataFrame, words: DataFrame, held: DataFrame, min_documents: int, threshold: float,
    remove_at: float, min_joint: int, margin: float,
) -> tuple[DataFrame, DataFrame]:
    """(entity, word, disclosure, action) of the words that give an entity away, and the pairs
    (__key, entity, word) they were chosen from.

    ``words`` has the distinct (__key, word) of the texts with personal data, ``held`` their
    distinct (__key, entity, part, kind).

    With p taken as the share of all documents, the disclosure of entity c by word t is
    PMI(c; t) / IC(c) = log(p(t|c) / p(t)) / -log p(c): 1 if the word occurs only with the
    entity, 0 if independent. Most values are too rare for p(t|c) to be a count: it is smoothed
    by that of the part that values share (mail domain, prefix, first digits), this by that of
    the kind, and this by p(t); the coarser estimate counts as ``min_documents`` documents. A word
    that discloses the part of a value discloses the value: the greater disclosure counts.
    Words from ``threshold`` on are generalised, from ``remove_at`` on removed.

    One meeting is no evidence, as every word of a text meets every value in it. A word
    counts only if at some level (value, part or kind) it was met with in ``min_joint``
    documents, and the lower confidence end of p(t|c) there is ``margin`` times p(t).
    """
    n_docs = max(1, docs.count())
    total = F.lit(float(n_docs))
    levels = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(level).alias("node"),
                 F.col(part).alias("part"), F.col("kind"))
        for level, part in (("entity", "part"), ("part", "part"), ("kind", "kind"))
    ])).alias("x")
    nodes = held.select("__key", levels).select("__key", "x.*").distinct()
    sizes = materialize(
        nodes.groupBy("node").agg(
            F.count(F.lit(1)).alias("n_node"), F.first("level").alias("level")), "pii-entities"
    )
    # Over all documents, counted before anything is shuffled.
    every = docs.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0)), F.lower))).alias("word"))
    seen = materialize(
        every.groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
        .where(F.col("n_word") >= min_joint)
        .join(words.groupBy("word").agg(F.count(F.lit(1)).alias("__n"))
              .where(F.col("__n") >= min_joint).select("word"), "word"),
        "pii-words",
    )
    # No word can disclose more than log(N / n_word): the frequent ones are out, losing nothing.
    most = sizes.where((F.col("level") != "kind") & (F.col("n_node") < n_docs)).agg(
        F.max("n_node")).first()[0] or 1

    def can(n: Column) -> Column:
        return F.log(total / F.col("n_word")) >= threshold * F.log(total / n) - 1e-6

    kept = materialize(
        salted_join(words, seen.where(can(F.lit(float(most)))), ["word"], ["__key"])
        .select("__key", "word"), "pii-rare"
    )
    pairs = materialize(
        kept.join(held.select("__key", "entity").distinct(), "__key"), "pii-pairs"
    )
    joint = materialize(
        kept.join(nodes, "__key").groupBy("level", "node", "part", "kind", "word")
        .agg(F.count(F.lit(1)).alias("n_joint")),
        "pii-joint",
    )

    def level(name: str, *above: str) -> DataFrame:
        rows = materialize(joint.where(F.col("level") == name), f"pii-{name}")
        return salted_join(rows, sizes.drop("level"), ["node"], ["word"]).select(
            F.col("node").alias(f"__{name}"), *above, "word",
            F.col("n_joint").alias(f"j_{name}"), F.col("n_node").alias(f"n_{name}"),
        ).withColumnRenamed(f"__{name}", name)

    share = F.col("n_word") / total

    def disclosure(p: Column, n: str) -> Column:
        content = -F.log(F.col(n) / total)
        return F.when(content > 0, F.round(F.log(p / share) / content, 9)).otherwise(0.0)

    def smoothed(name: str, prior: Column) -> Column:
        return (F.col(f"j_{name}") + min_documents * prior) / (F.col(f"n_{name}") + min_documents)

    def evident(name: str) -> Column:
        j, n = F.col(f"j_{name}"), F.col(f"n_{name}")
        return (j >= min_joint) & (_lower_share(j, n) >= margin * share)

    parts = (
        level("part", "kind").join(level("kind"), ["kind", "word"]).join(seen, "word")
        .where(can(F.col("n_part")))
        .withColumn("p_part", smoothed("part", smoothed("kind", share)))
        .withColumn("by_part", disclosure(F.col("p_part"), "n_part"))
        .withColumn("evident", evident("part") | evident("kind"))
        .select("part", "word", "n_word", "p_part", "by_part", "evident")
    )
    values = materialize(level("entity", "part"), "pii-values")
    by_value = disclosure(smoothed("entity", F.col("p_part")), "n_entity")
    found = salted_join(values, parts, ["part", "word"], ["entity"]).withColumn(
        "disclosure", F.greatest(by_value, "by_part")
    ).where(F.col("evident") | evident("entity"))
    return found.where(F.col("disclosure") >= threshold).select(
        "entity", "word", "disclosure",
        F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action"),
    ), pairs


ADDED = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised"]


def sanitise(
    docs: DataFrame,
    min_documents: int = 3,
    threshold: float = 0.8,
    remove_at: float = 0.95,
    min_joint: int = 2,
    margin: float = 2.0,
) -> DataFrame:
    """Mark and replace personal data and the words that disclose it, in whole texts.

    Base spans are the matches of four patterns (email, ip, card, phone) that pass their
    tests. Further spans of kind ``term`` are words anywhere in a document with a base span
    which, by their co-occurrence over all documents, disclose its value: see
    ``disclosing_terms``. They are replaced wherever they occur in that document; a rare word
    that was met in one document only discloses nothing. In ``sanitised`` a base span becomes
    ``<KIND>``, a generalised word ``<NUMBER>`` or ``<WORD>``, a removed word nothing; where spans of
    two kinds overlap, the one that starts first (then the longer) is replaced and the
    overlapping rest goes with it.

    Returns all columns of ``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 (of the
    base spans as ``kind:start:end`` in code points, end exclusive, by kind and start),
    ``spans`` (base, then terms by start) and ``sanitised``. A NULL text is empty. Rows are
    told apart by (doc_id, text): repeated rows count as one document and get equal results.
    Documents without personal data pass unchanged. Empty tables give no rows.
    """
    clean = without(docs, ADDED)
    keyed = clean.withColumn(
        "__key",
        F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                    F.xxhash64(whole_text()).cast("string"), F.crc32(whole_text()).cast("string")),
    )
    found = materialize(
        keyed.select("__key", whole_text().alias("t")).withColumn("base", base_spans(F.col("t")))
        .where(F.size("base") > 0).dropDuplicates(["__key"]).select("__key", "base", "t"),
        "pii-found",
    )
    held = materialize(
        found.select("__key", F.explode("base").alias("b")).select(
            "__key", _entity(F.col("b.kind"), F.col("b.v")).alias("entity"),
            _part(F.col("b.kind"), F.col("b.v")).alias("part"), "b.kind",
        ).distinct(),
        "pii-held",
    )
    words = materialize(_occurrences(found).select("__key", "word").distinct(), "pii-context")
    terms, pairs = disclosing_terms(
        clean, words, held, min_documents, threshold, remove_at, min_joint, margin
    )
    terms = materialize(terms, "pii-terms")
    disclosed = materialize(
        salted_join(pairs, terms, ["entity", "word"], ["__key"])
        .groupBy("__key", "word")
        .agg(F.max((F.col("action") == "remove").cast("int")).alias("remove")),
        "pii-disclosed",
    )
    # Positions only of words that disclose, in the texts that hold them.
    concerned = found.join(disclosed.select("__key").distinct(), "__key", "left_semi")
    marked = (
        _occurrences(concerned).join(disclosed, ["__key", "word"])
        .groupBy("__key")
        .agg(F.sort_array(F.collect_list(F.struct(
            "s", "e",
            F.when(F.col("remove") == 1, "").when(F.col("word").rlike(r"^\p{N}+$"), "<NUMBER>")
            .otherwise("<WORD>").alias("by"),
        ))).alias("terms"))
    )
    spans = found.select("__key", "base").join(marked, "__key", "left").select(
        F.col("__key").alias("__k"), "base",
        F.coalesce("terms", F.array().cast(TERM_TYPE)).alias("terms"),
    )
    rows = keyed.join(spans, F.col("__key") == F.col("__k"), "left").withColumns({
        "__base": F.coalesce("base", F.array().cast(BASE_TYPE)),
        "__terms": F.coalesce("terms", F.array().cast(TERM_TYPE)),
    })
    base_list = F.array_join(F.transform("__base", lambda m: F.concat_ws(
        ":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")
    term_list = F.array_join(F.transform("__terms", lambda m: F.concat_ws(
        ":", F.lit(TERM), m["s"].cast("string"), m["e"].cast("string"))), ",")
    replaced = F.sort_array(F.concat(
        F.transform("__base", lambda m: F.struct(
            m["s"].alias("s"), (-m["e"]).alias("e"),
            F.concat(F.lit("<"), F.upper(m["kind"]), F.lit(">")).alias("by"))),
        F.transform("__terms", lambda m: F.struct(
            m["s"].alias("s"), (-m["e"]).alias("e"), m["by"].alias("by"))),
    ))

    def cut(acc: Column, m: Column) -> Column:
        end = -m["e"]
        return F.when(
            m["s"] >= acc["at"],
            F.struct(
                end.alias("at"),
                F.concat(acc["out"], F.substr(whole_text(), acc["at"] + 1, m["s"] - acc["at"]),
                         m["by"]).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out")))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("__base", lambda m: m["kind"] == kind)).cast("bigint")

    folded = F.aggregate(
        replaced, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut,
        lambda acc: F.concat(
            acc["out"],
            F.substr(whole_text(), acc["at"] + 1, F.length(whole_text())),
        ),
    )
    return rows.select(
        *clean.columns,
        *[count_of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(base_list, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base_list, F.lit("")), F.nullif(term_list, F.lit("")))
        .alias("spans"),
        folded.alias("sanitised"),
    )
