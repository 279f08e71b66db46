"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary is a SentencePiece model file.  Its merge ranks become Zipf log-probabilities
``-log((rank + 1) * H)``, and a text gets the segmentation of the highest sum; a character
that no piece holds falls back to its UTF-8 byte pieces.  So ids differ from those of greedy
pair merging with the same file, and every text decodes to itself.

The search streams: it keeps the best score and the backpointer of the boundaries in a window
of the longest piece, and commits ids whenever all surviving backpointer paths run through
one boundary.  That is always so where no piece crosses, as before each word mark.  So the
text is cut there into stretches, each goes through the search, and tasks keep what it gave
for stretches of up to ``CACHED`` code points (at most ``MEMO`` of them), as words recur.

Spaces become the word mark, one is put before a text that isn't empty, and decoding takes it
away; a word mark that stands in the text itself is encoded as bytes.

Defined results: null text has no ids and decodes to null; empty text has none and decodes to
the empty text; repeated rows repeat; an empty table gives an empty result; other columns are
kept, but those of the names that ``encode`` and ``decode`` add are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm import textkit as tk

MARK = "▁"
MEMO = 3 << 17
INFINITE = float("inf")
CACHED = 64


class PieceCodec:
    """Encoder and decoder for the pieces of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        byte_ids = {int(pieces[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        usable = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        harmonic = sum(1 / (i + 1) for i in range(size))
        ranks = {i: rank for rank, i in enumerate(sorted(usable, key=lambda i: (-model.get_score(i), i)))}
        self.cost = {pieces[i]: (log((ranks[i] + 1) * harmonic), i) for i in usable}
        self.byte_cost = log((size + 1) * harmonic)
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.longest = max(map(len, self.cost))
        self.bytes_of = [b"" if model.is_control(i) or model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in byte_ids.items():
            self.bytes_of[i] = bytes([b])
        # no piece crosses the boundary before a mark or beside a character of no piece
        inside = any(MARK in p.lstrip(MARK) for p in self.cost)
        self.stretch = re.compile(r"(?s).+" if inside else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if "\n" not in "".join(self.cost) else rf"{MARK}*[^{MARK}]+|{MARK}+")
        self.root: dict[str, list] = {}  # character -> [next characters, cost, id or -1]
        for p, (price, i) in self.cost.items():
            level, node = self.root, []
            for character in p:
                node = level.setdefault(character, [{}, 0.0, -1])
                level = node[0]
            node[1:] = price, i
        self.memo: dict[str, bytes] = {}

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of marked text, as they are committed."""
        root, n, longest, window = self.root, len(text), self.longest, 4 * self.longest
        # of the boundaries from ``done`` on: least cost, the boundary before, and the piece between (-1 for bytes)
        cost, back, piece = [0.0], [0], [-1]
        done, reach, limit = 0, 0, window
        for at in range(n):
            if at > done and reach <= at:  # every surviving path runs through this boundary
                yield self._commit(text, back, piece, done, at)
                cost, back, piece = [cost[at - done]], [0], [-1]
                done, limit = at, window
            elif at - done >= limit:  # or meets in an earlier one
                meet = self._meeting(back, done, at, reach)
                limit = 2 * (at - done)  # paths that don't meet soon are followed back ever more seldom
                if meet > done:
                    yield self._commit(text, back, piece, done, meet)
                    cost, back, piece = cost[meet - done :], back[meet - done :], piece[meet - done :]
                    done, limit = meet, window
            room = min(n, at + longest) - done + 1 - len(cost)
            if room > 0:
                cost += [INFINITE] * room
                back += [0] * room
                piece += [-1] * room
            k = at - done
            here, level = cost[k], root
            for character in text[at : at + longest]:
                node = level.get(character)
                if node is None:
                    break
                level, price, found = node
                k += 1
                if found >= 0 and here + price < cost[k]:
                    cost[k], back[k], piece[k] = here + price, at, found
                    if k + done > reach:
                        reach = k + done
            node = root.get(text[at])
            if node is None or node[2] < 0:
                price, k = self.byte_cost * len(text[at].encode()), at + 1 - done
                if here + price < cost[k]:
                    cost[k], back[k], piece[k] = here + price, at, -1
                    if at + 1 > reach:
                        reach = at + 1
        if n:
            yield self._commit(text, back, piece, done, n)

    @staticmethod
    def _meeting(back: list[int], done: int, at: int, reach: int) -> int:
        """The last boundary that the paths to all live ends share."""
        live = set(range(at, min(reach, done + len(back) - 1) + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last - done] if last > done else done)
        return live.pop() if live else done

    def _commit(self, text: str, back: list[int], piece: list[int], done: int, end: int) -> list[int]:
        """The ids from the boundary ``done`` to ``end``, by the backpointers."""
        ids: list[int] = []
        start = done
        while end > start:
            before, found = back[end - done], piece[end - done]
            if found >= 0:
                ids.append(found)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[before:end].encode()))
            end = before
        ids.reverse()
        return ids

    def _stretch_ids(self, stretch: str) -> bytes:
        """What ``stream`` gives for a stretch, as 32-bit integers, from the memo if it was met before."""
        ids = self.memo.get(stretch)
        if ids is None:
            ids = array("i", (i for part in self.stream(stretch) for i in part)).tobytes()
            if len(stretch) <= CACHED:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[stretch] = ids
        return ids

    def encode_into(self, text: str, out: array) -> None:
        """Appends the ids of ``text``."""
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.extend(self.byte_ids[b] for b in MARK.encode())
            marked = part.replace(" ", MARK)
            if not k and text:
                marked = MARK + marked
            for stretch in self.stretch.findall(marked):
                out.frombytes(self._stretch_ids(stretch))

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: list[int] | array) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if data.startswith(" ") else data


def codec(model_file: str) -> PieceCodec:
    """The codec of a model file, kept by the Python worker until tasks that need much memory run there."""
    return tk.kept(f"pieces of {model_file}", lambda: PieceCodec(model_file))


def _shipped(df: DataFrame, model_file: str) -> str:
    """Sends the model file to every executor; the name by which tasks find it."""
    import os

    df.sparkSession.sparkContext.addFile(model_file)
    return os.path.basename(model_file)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """Adds ``ids``, ``n_ids`` and ``round_trip`` (whether the ids decode to the text)."""
    name = _shipped(docs, model_file)
    columns = [c for c in docs.columns if c not in ("ids", "n_ids", "round_trip")]
    kept = docs.select(*columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(at, 256)
                out, ends, same = array("i"), [0], []
                texts = batch.column("text").to_pylist()
                for text in texts:
                    if text is not None:
                        own.encode_into(text, out)
                        same.append(own.decode(out[ends[-1] :]) == text)
                    else:
                        same.append(None)
                    ends.append(len(out))
                missing = np.array([t is None for t in texts], dtype=bool)
                offsets = pa.array(np.array(ends, dtype=np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(np.array(ends, dtype=np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(out, dtype=np.int32) if len(out) else np.zeros(0, np.int32)))
                counts = pa.array(np.diff(ends).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, counts, pa.array(same, pa.bool_())], names=[*columns, "ids", "n_ids", "round_trip"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` (null for null)."""
    name = _shipped(encoded, model_file)
    columns = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(at, 256)
                texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
