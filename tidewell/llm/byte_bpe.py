"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

The vocabulary is a rank file (a token in base64 and its rank on each line).  A text is split
by a pattern, and each match is merged separately: of all neighbours that together are a
token, those of the lowest rank first, the leftmost of equal ones.

**Transducer.**  A sequence of tokens is what merging gives if and only if each two
neighbours stay apart when their bytes alone are merged, as the first merge across a border
would happen in those two alone as well.  So each prefix of a match has one last token, and
reading a byte can go on with any token that has begun at a border before.  A state is the
set of these beginnings: the place in the tree of tokens, the token before, and the output
not yet written.  There are at most as many as the longest token has bytes, which bounds the
lookahead: output that all of them share is written at once.  States and their steps are made
when a byte first asks for them, ``STATES`` at most; then they are made afresh.  Words recur,
so a task also keeps what the transducer wrote for the last ``MEMO`` to 2 ``MEMO`` matches.

**Decoder.**  A state machine of UTF-8 reads whole tokens: its state after a token from each
state is a table.  The state says how many bytes of the last code point are there; these are
held back until the rest comes, so ids can be decoded in chunks cut anywhere.

``ids`` is kept as the little-endian unsigned 32-bit integers of a text, one binary value.

Defined results: null text has null ids, and null ids decode to null; empty text has no ids
and decodes to the empty text; bytes that aren't UTF-8 count as U+FFFD; an id without a token
decodes to U+FFFD; repeated rows repeat; an empty table gives an empty result; other columns
are kept, but those of the names that ``encode`` and ``decode`` add are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm import textkit

STATES, MEMO, CACHED = 1 << 17, 1 << 18, 64
PAIRS = 1 << 19
NEVER = 1 << 62
WIDE = 32
CHUNK, LONG = 1 << 14, 1 << 18
_CODECS: dict[bytes, ByteCodec] = {}

#: For each beginning, oldest first: the node of the tree, the token before (-1: none), and the unwritten output.
State = tuple[int | tuple[int, ...], ...]


class Utf8Machine:
    """States of UTF-8 decoding; a byte that can't go on begins anew."""

    #: For each state, the bytes of the code point read so far, and steps as (first byte, last byte, next state).
    STATES = (
        (0, ((0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7))),
        (1, ((0x80, 0xBF, 0),)),
        (1, ((0xA0, 0xBF, 8),)),
        (1, ((0x80, 0xBF, 8),)),
        (1, ((0x80, 0x9F, 8),)),
        (1, ((0x90, 0xBF, 9),)),
        (1, ((0x80, 0xBF, 9),)),
        (1, ((0x80, 0x8F, 9),)),
        (2, ((0x80, 0xBF, 0),)),
        (2, ((0x80, 0xBF, 10),)),
        (3, ((0x80, 0xBF, 0),)),
    )

    def __init__(self, tokens: list[bytes]):
        step = np.zeros((len(self.STATES), 256), dtype=np.uint8)
        for first, last, to in self.STATES[0][1]:
            step[:, first : last + 1] = to
        for state, (_, steps) in enumerate(self.STATES):
            for first, last, to in steps:
                step[state, first : last + 1] = to
        after = np.repeat(np.arange(len(self.STATES), dtype=np.uint8)[:, None], len(tokens), axis=1)
        lengths = np.array([len(t) for t in tokens])
        for place in range(max(lengths, default=0)):
            own = np.flatnonzero(lengths > place)
            after[:, own] = step[after[:, own], np.array([tokens[i][place] for i in own], dtype=np.uint8)]
        self.after = [row.tobytes() for row in after]
        #: Tokens after which the machine is between code points, whatever came before.
        self.ends = (after == 0).all(axis=0).tobytes()
        self.held = [read for read, _ in self.STATES]

    def run(self, state: int, ids: list[int]) -> int:
        """The state after some tokens; those before one of ``ends`` don't matter."""
        at = len(ids)
        while at and not self.ends[ids[at - 1]]:
            at -= 1
        if at:
            state = 0
        for i in ids[at:]:
            state = self.after[state][i]
        return state


class ByteCodec:
    """Encoder and decoder for the tokens of one rank file."""

    def __init__(self, rank_lines: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_lines.splitlines()) if token}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("each byte must be a token")
        self.unknown = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = ["\ufffd".encode()] * (self.unknown + 1)
        self.children: list[dict[int, int]] = [{}]  # of each node of the tree of tokens: byte -> node; the root is 0
        self.token: list[int] = [-1]
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = rank
        empty: dict[int, int] = {}
        self.children = [c or empty for c in self.children]
        self.machine = Utf8Machine(self.bytes_of)
        self.pairs: dict[int, bool] = {}  # left token << WIDE | right token
        self.histories: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self.memo = _Memo(self)
        self._forget()

    # --- the transducer ---

    def _forget(self) -> None:
        self.states: dict[State, int] = {}
        self.content: list[State] = []
        self.final: list[tuple[int, ...]] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte -> next state and what is written
        self._number((0, -1, ()))

    def _number(self, state: State) -> int:
        found = self.states.get(state)
        if found is None:
            found = self.states[state] = len(self.content)
            self.content.append(state)
            whole = self.token[state[0]] if state[1] < 0 else -1
            self.final.append((whole,) if whole >= 0 else state[-1])
        return found

    def merged(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The parts that plain merging leaves, and its history: the rank of each merge, and the first and last part before it."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        history = []
        while ranks and (rank := min(ranks)) != NEVER:
            at = ranks.index(rank)
            history.append((rank, parts[0], parts[-1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = self.ranks.get(parts[i] + parts[i + 1], NEVER)
        history.append((NEVER, parts[0], parts[-1]))
        return parts, history

    def history(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """The history of a token, none if merging its bytes doesn't give it."""
        if token not in self.histories:
            parts, history = self.merged(self.bytes_of[token])
            self.histories[token] = history if len(parts) == 1 else None
        return self.histories[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are beside each other: no merge across their border comes first at any time."""
        key = left << WIDE | right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.history(left), self.history(right)
            found = a is not None and b is not None and self._unmerged(a, b)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _unmerged(self, a: list[tuple[int, bytes, bytes]], b: list[tuple[int, bytes, bytes]]) -> bool:
        i = j = 0
        before = None
        while True:
            (own, _, x), (other, y, _) = a[i], b[j]
            if before != (x, y):
                before, across = (x, y), self.ranks.get(x + y, NEVER)
            if across < own and across <= other:
                return False
            if own == other == NEVER:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The determinised step from a state: where it leads, and the output that all beginnings share."""
        children, tokens, pairs, state = self.children, self.token, self.pairs, self.content[number]
        going: list[int | tuple[int, ...]] = []
        border: tuple[int, ...] | None = None
        for node, before, unwritten in zip(state[::3], state[1::3], state[2::3], strict=True):
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node] or before < 0:  # else nothing can follow it
                going += (node, before, unwritten)
            if border is None and (token := tokens[node]) >= 0:
                if before < 0:
                    fits = self.history(token) is not None
                else:
                    fits = pairs.get(before << WIDE | token)
                    if fits is None:
                        fits = self.apart(before, token)
                if fits:
                    last, border = token, (*unwritten, token)
        if border is None:
            raise AssertionError("each byte is a token, so each prefix has a last token")
        common = 0
        if not going:
            common = len(border)
        elif going[2]:
            oldest, common = going[2], len(going[2])
            for unwritten in (*going[5::3], border):
                while unwritten[:common] != oldest[:common]:
                    common -= 1
        going += (0, last, border)
        written = border[:common]
        if common:
            going[2::3] = [u[common:] for u in going[2::3]]
        if len(self.content) >= STATES:
            self._forget()
            return self._number(tuple(going)), written
        to = self._number(tuple(going))
        self.steps[number << 8 | byte] = to, written
        return to, written

    def advance(self, state: int, data: bytes, out: list[int]) -> int:
        """The state after some bytes of a match; what is written meanwhile is put to ``out``."""
        steps = self.steps
        for byte in data:
            found = steps.get(state << 8 | byte)
            if found is None:
                found = self._step(state, byte)
                steps = self.steps
            state, written = found
            if written:
                out += written
        return state

    def stream(self, data: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one match of the pattern, given in parts, as they are written."""
        state = 0
        for part in data:
            state = self.advance(state, part, out := [])
            yield out
        yield list(self.final[state])

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        matches = self.pattern.findall(text) if len(text) <= LONG else map(itemgetter(0), self.pattern.finditer(text))  # long texts one by one
        return b"".join(map(self.memo.__getitem__, matches))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    # --- the decoder ---

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[bytes]:
        """UTF-8 of whole code points for each chunk of ids, then what is left."""
        state, held = 0, b""
        for chunk in chunks:
            ids = [i if 0 <= i < self.unknown else self.unknown for i in chunk]
            state = self.machine.run(state, ids)
            data = held + b"".join(map(self.bytes_of.__getitem__, ids))
            cut = len(data) - self.machine.held[state]
            held = data[cut:]
            yield data[:cut]
        yield held

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        ids = np.frombuffer(packed, dtype="<u4")
        chunks = (ids[at : at + CHUNK].tolist() for at in range(0, len(ids), CHUNK))
        return "".join(part.decode("utf-8", "replace") for part in self.decode_stream(chunks))


class _Memo(dict):
    """What the transducer wrote for a match, packed; those that were of use lately outlive the others."""

    def __init__(self, codec: ByteCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, match: str) -> bytes:
        found = self.older.get(match)
        if found is None:
            data, ids = match.encode("utf-8", "replace"), []
            state = self.codec.advance(0, data, ids)
            ids += self.codec.final[state]
            found = pack(f"<{len(ids)}I", *ids)
        if len(match) <= CACHED:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[match] = found
        return found


def codec(rank_lines: bytes, pattern: str) -> ByteCodec:
    """The codec of a rank file, kept by the Python worker."""
    key = hashlib.sha256(rank_lines + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = ByteCodec(rank_lines, pattern)
    return _CODECS[key]


def texts_of(column: pa.Array) -> list[str | None]:
    """The strings of a column, U+FFFD for bytes that aren't UTF-8."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _lines(df: DataFrame, rank_file: str):
    """The rank file on every executor; it is a vocabulary, so it doesn't grow with the data."""
    with open(rank_file, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, rank_file: str, pattern: str, keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` and ``n_tokens`` of ``text``, and drops ``text`` if it isn't to be kept."""
    lines = _lines(docs, rank_file)
    columns = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    kept = docs.select(*columns)
    fields = [f for f in kept.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines.value, pattern)
        for batch in batches:
            for at, part in textkit.slices(batch.column("text")):
                mine = batch.slice(at, len(part))
                packed = [None if t is None else own.packed(t) for t in texts_of(mine.column("text"))]
                counts = [None if p is None else len(p) // 4 for p in packed]
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in names), pa.array(packed, pa.binary()), pa.array(counts, pa.int64())], names=[*names, "ids", "n_tokens"])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``."""
    lines = _lines(encoded, rank_file)
    columns = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
