"""The transducer against the public library, and the streaming decoder against Python's."""

import codecs
import hashlib
import random
from array import array

import duckdb
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm.byte_bpe import (
    Encoder, StreamDecoder, Transducer, decode, encode, parse_ranks, read_ranks,
)
from quillmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATHS = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def tables(name):
    ranks = parse_ranks(read_ranks(public_tokenizers.path(name)))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return ranks, library, Encoder(ranks, public_tokenizers.PATTERN)


TABLES = {name: tables(name) for name in PATHS}


def ids(encoder, text):
    return array("i", encoder.ids(text)).tolist()


@pytest.mark.parametrize("name", PATHS)
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(name, text):
    _, library, encoder = TABLES[name]
    text = text.encode("utf-8", "replace").decode()
    assert ids(encoder, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("name", PATHS)
def test_joined_tokens_and_long_runs(name):
    ranks, library, encoder = TABLES[name]
    draw, tokens = random.Random(5), list(ranks)
    pieces = [b"".join(draw.choice(tokens) for _ in range(draw.randint(2, 8))) for _ in range(3000)]
    pieces += [x * 7001 for x in (b"a", b" ", b"-", b"ab", b"\xe2\x82\xac", b"=-")]
    for piece in pieces:
        assert encoder.transducer.piece(piece) == library._encode_single_piece(piece)


def test_lookahead_is_bounded():
    ranks, _, encoder = TABLES[PATHS[0]]
    machine = encoder.transducer
    machine.piece(b"the quick brown fox" * 500)
    longest = max(map(len, ranks))
    assert max(len(begun) for ways in machine.ways for _, _, begun in ways) < longest
    assert all(sum(not begun for _, _, begun in ways) == 1 for ways in machine.ways)


def test_small_tables_are_emptied_and_filled_anew():
    ranks, library, _ = TABLES[PATHS[0]]
    machine, small = Transducer(ranks, max_moves=50), Encoder(ranks, public_tokenizers.PATTERN, 3)
    text = "Now is the winter of our discontent made glorious summer, isn't it? 12345 " * 3
    assert ids(small, text) == library.encode_ordinary(text)
    for word in text.split():
        assert machine.piece(word.encode()) == library._encode_single_piece(word.encode())
        assert len(machine.moves) < 50 + 4 * len(word)


def test_a_table_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        Transducer({b"a": 0, b"b": 1}).piece(b"ac")


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(0, 60), max_size=8))
def test_utf8_machine_equals_the_codec(data, cuts):
    cuts = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    tokens = dict(enumerate(parts))
    theirs = codecs.getincrementaldecoder("utf-8")("replace")
    whole = StreamDecoder(tokens)
    got = whole.feed(range(len(parts))) + whole.finish()
    assert got == "".join(theirs.decode(p) for p in parts) + theirs.decode(b"", True)


def test_streaming_keeps_open_characters():
    decoder = StreamDecoder({0: b"a\xf0\x9f", 1: b"\x98", 2: b"\x80b", 3: b"\xe2"})
    assert [decoder.feed([i]) for i in (0, 1, 2)] == ["a", "", "\U0001f600b"]
    assert decoder.feed([3]) == "" and decoder.finish() == "�" and decoder.finish() == ""
    assert decoder.feed([99, 0, 0]) == "�a�a" and decoder.finish() == "�"


def test_rows(spark):
    path = public_tokenizers.path(PATHS[0])
    long = "Lorem ipsum " * 40_000
    rows = [(1, None, "i"), (2, "", "i"), (3, " \n\t", "i"), (4, "été \U0001f600 日本", "i"),
            (4, "été \U0001f600 日本", "i"), (None, "x", "i"), (5, long, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(docs, path, public_tokenizers.PATTERN), path).collect()
    library = TABLES[PATHS[0]][1]
    assert sorted((str(r["doc_id"]), r["decoded"], r["ids"]) for r in got) == sorted(
        (str(d), t or "", library.encode_ordinary(t or "")) for d, t, _ in rows)
    none = docs.where(F.lit(False))
    assert decode(encode(none, path, public_tokenizers.PATTERN), path).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([-1, 220],)], "ids array<int>")
    assert sorted(r["decoded"] for r in decode(odd, path).collect()) == ["", "", "� "]


def test_query_equals_the_library(spark):
    library = TABLES[PATHS[0]][1]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_bpe_transducer"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for d, text in rows:
        tokens = library.encode_ordinary(text or "")
        assert got[d] == (
            len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )
