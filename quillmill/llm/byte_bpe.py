"""Byte-level BPE as a transducer that is determinised while it reads, and its inverse."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmill.llm.common import without

#: Bounds of the tables that a Python worker holds; a full one is emptied and filled anew.
MAX_MOVES = 1 << 19
MAX_PIECES = 1 << 18
MAX_VOCABULARY_BYTES = 64 << 20


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Token -> rank of a file of ``base64 rank`` lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def read_ranks(path: str) -> bytes:
    """The rank file, of bounded size, so that it may travel with the job."""
    with open(path, "rb") as file:
        lines = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(lines) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} exceeds {MAX_VOCABULARY_BYTES} bytes")
    return lines


NEVER = 1 << 62


class Transducer:
    """Bytes to tokens from left to right, equal to merging the pair of lowest rank first.

    What merging does on the two sides of a token boundary never depends on anything beyond
    the two tokens. So a sequence of tokens is the merged form of its bytes if and only if
    each neighbouring pair is that of its own bytes, and a text has exactly one. That is a
    transducer that guesses tokens: it reads the bytes of a token, and may end it if the
    token may follow the one before. Its subsets are built when bytes first lead to them: a
    state is the set of guesses still open. Exactly one guess ends at any place, so a move
    gives the token that ends there. Guesses die within the bytes of the longest token;
    tokens that all open guesses have in common are emitted (``settle``), every
    ``LOOKAHEAD`` bytes.

    Two tokens may not follow each other if a last symbol of the left one and a first symbol
    of the right one merge first: at a rank below the next growth of the left symbol, and
    not above that of the right one, since of equal ranks the leftmost pair merges first. A
    guess (barred, live, begun) holds what of this is still open after the bytes ``begun``:
    per length of a first symbol the lowest rank at which it is taken away, and the last
    symbols, with the rank of their growth, that longer first symbols could still join.
    """

    LOOKAHEAD = 256

    def __init__(self, ranks: dict[bytes, int], max_moves: int = MAX_MOVES):
        self.ranks, self.max_moves = ranks, max_moves
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.open = {token[:i] for token in ranks for i in range(1, len(token))}
        self._symbols: dict[int, tuple] = {}
        self.bits = max(ranks.values()).bit_length()
        self._reset()

    def _reset(self) -> None:
        #: 256 * state + byte -> (next state, token that ends here) in one number
        self.moves: dict[int, int] = {}
        self.ways: list[tuple] = [(((), (), b""),)]
        self._numbers = {self.ways[0]: 0}

    def symbols(self, token: int) -> tuple | None:
        """First and last symbols of a token while it is merged from its bytes.

        The first ones as {length: rank of the merge that ends it}, the last ones that
        anything could be joined to as (symbol, rank). None for a token that merging its
        bytes does not give.
        """
        if token in self._symbols:
            return self._symbols[token]
        text = self.tokens[token]
        parts = [text[i:i + 1] for i in range(len(text))]
        first, last = {}, []
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)
            )
            if rank == NEVER:
                break
            if at == 0:
                first[len(parts[0])] = rank
            if at == len(parts) - 2:
                last.append((parts[-1], rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        first[len(text)] = NEVER
        last.append((text, NEVER))
        self._symbols[token] = None if len(parts) > 1 else (
            first, tuple((symbol, rank) for symbol, rank in last if symbol in self.open)
        )
        return self._symbols[token]

    def _move(self, key: int) -> int:
        byte, ways, ended, get = bytes((key & 255,)), [], None, self.ranks.get
        for barred, live, begun in self.ways[key >> 8]:
            begun += byte
            token = get(begun)
            goes_on = begun in self.open
            if token is None and not goes_on:
                continue
            joins = [rank for last, grows in live
                     if (rank := get(last + begun)) is not None and rank < grows]
            if joins:
                barred = (*barred, (len(begun), min(joins)))
            if goes_on:
                live = tuple((last, grows) for last, grows in live if last + begun in self.open)
                ways.append((barred, live, begun))
            known = token is not None and self.symbols(token)
            if known and not any(rank <= known[0].get(size, -1) for size, rank in barred):
                if ended is not None:
                    raise ValueError("the ranks are no merge table")
                ended = token
        if ended is None:
            raise ValueError("the ranks are no merge table over all bytes")
        state = (*ways, ((), self.symbols(ended)[1], b""))
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self.ways)
            self.ways.append(state)
        step = self.moves[key] = number << 8 + self.bits | ended
        return step

    def settle(self, ends: list[int], starts: set[int], out: list[int]) -> list[int]:
        """Emit the tokens before the place where all open guesses come from; the rest stays."""
        tokens = self.tokens
        while len(starts) > 1:
            far = max(starts)
            starts.remove(far)
            starts.add(far - len(tokens[ends[far - 1]]))
        certain = at = starts.pop()
        emitted = []
        while at:
            token = ends[at - 1]
            emitted.append(token)
            at -= len(tokens[token])
        emitted.reverse()
        out += emitted
        return ends[certain:]

    def piece(self, text: bytes) -> list[int]:
        """The tokens of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.max_moves:
            self._reset()
        moves, move, bits, token_bits = self.moves.get, self._move, self.bits, (1 << self.bits) - 1
        state, ends, out = 0, [], []
        for at in range(0, len(text), self.LOOKAHEAD):
            for byte in text[at:at + self.LOOKAHEAD]:
                step = moves(state + byte)
                if step is None:
                    step = move(state + byte)
                ends.append(step & token_bits)
                state = step >> bits & -256
            if at + self.LOOKAHEAD < len(text):
                starts = {len(ends) - len(begun) for _, _, begun in self.ways[state >> 8]}
                ends = self.settle(ends, starts, out)
        self.settle(ends, {len(ends)}, out)
        return out


class Encoder:
    """Texts to token ids: cut by a pattern, each piece through the transducer.

    The ids of the pieces met are kept as bytes, in two tables: a full one becomes the older
    one, from which pieces that come again move back.
    """

    LONG = 1 << 20

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(ranks)
        self.cut = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.max_pieces = max_pieces

    def _learn(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.transducer.piece(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self.known) >= self.max_pieces:
                self.older = dict(self.known)
                self.known.clear()
            self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        known, learn = self.known.get, self._learn
        if len(text) <= self.LONG:
            return b"".join([known(word) or learn(word) for word in self.cut.findall(text) if word])
        words = (found.group() for found in self.cut.finditer(text))
        return b"".join(known(word) or learn(word) for word in words if word)


def _utf8_lead(byte: int) -> tuple[int, int, int] | None:
    """(continuation bytes, lowest and highest value of the first of them) after a lead byte."""
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class StreamDecoder:
    """Token ids to text while they arrive, by a UTF-8 machine that may stop inside a character.

    The state is the begun character (at most three bytes). Each ill-formed part and each
    unknown id becomes U+FFFD. Moves are remembered per (state, id).
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        read = {token: self.read(b"", data) for token, data in tokens.items()}
        self.whole = {token: text for token, (text, begun) in read.items() if not begun}
        self.begun = b""

    @staticmethod
    def read(begun: bytes, data: bytes) -> tuple[str, bytes]:
        """Text completed by ``data`` after ``begun``, and the character it leaves open."""
        out, held = [], bytearray(begun)
        for byte in data:
            if held:
                need, low, high = _utf8_lead(held[0])
                low, high = (low, high) if len(held) == 1 else (0x80, 0xBF)
                if low <= byte <= high:
                    held.append(byte)
                    if len(held) == need + 1:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")
                held.clear()
            if byte < 0x80:
                out.append(chr(byte))
            elif _utf8_lead(byte):
                held.append(byte)
            else:
                out.append("�")
        return "".join(out), bytes(held)

    def feed(self, ids: list[int]) -> str:
        out = []
        for at in range(0, len(ids), 512):
            part = ids[at:at + 512]
            if not self.begun:
                # Nothing is open and every token is whole characters: no state to carry.
                whole = list(map(self.whole.get, part))
                if None not in whole:
                    out += whole
                    continue
            out.append(self._step(part))
        return "".join(out)

    def _step(self, ids: list[int]) -> str:
        moves, begun, out = self.moves, self.begun, []
        for token in ids:
            step = moves.get((begun, token))
            if step is None:
                data = self.tokens.get(token, b"\xff")
                step = moves[(begun, token)] = self.read(begun, data)
            text, begun = step
            out.append(text)
        self.begun = begun
        return "".join(out)

    def finish(self) -> str:
        """Ends the text: a character that is still open becomes U+FFFD."""
        left, self.begun = self.begun, b""
        return "�" if left else ""


_WORKER: dict[tuple, object] = {}


def _once(kind, lines: bytes, *more):
    """One encoder or decoder per Python worker and rank file."""
    key = (kind, hash(lines), len(lines), *more)
    if key not in _WORKER:
        _WORKER.clear()
        ranks = parse_ranks(lines)
        _WORKER[key] = (
            Encoder(ranks, *more) if kind is Encoder
            else StreamDecoder({rank: token for token, rank in ranks.items()})
        )
    return _WORKER[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, rows_at_once: int = 500) -> DataFrame:
    """Add ``ids``, the tokens of every whole text under the ranks of a file, as tiktoken gives.

    ``pattern`` (of the ``regex`` module) cuts a text into pieces that are encoded
    separately; no special tokens. NULL and empty texts have no ids. Every row is kept with
    its columns; a column named ids is replaced. The driver reads the rank file, bounded in
    size, and sends it with the job, so executors need no path to it.
    """
    lines = read_ranks(ranks_path)
    kept = without(docs, ["ids"])
    text_column = next(c for c in kept.columns if c.lower() == "text")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, lines, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                ids = [encoder.ids(value.as_py() or "") for value in batch.column(text_column)]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(
    rows: DataFrame, ranks_path: str, out: str = "decoded", rows_at_once: int = 500
) -> DataFrame:
    """Add the text of the token ids in ``ids``; NULL ids give "", unknown ones U+FFFD."""
    lines = read_ranks(ranks_path)
    kept = without(rows, [out])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(StreamDecoder, lines)
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                texts = []
                lists = batch.column("ids")
                flat = lists.flatten().fill_null(-1).to_numpy()
                ends = pc.list_value_length(lists).fill_null(0).to_numpy().cumsum()
                for begin, end in zip([0, *ends[:-1]], ends):
                    texts.append(decoder.feed(flat[begin:end].tolist()) + decoder.finish())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], names=schema.names
                )

    return kept.mapInArrow(run, schema)
