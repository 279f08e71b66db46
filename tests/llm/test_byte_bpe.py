"""The byte-level codec against the tokenizer library and against plain merging."""

from __future__ import annotations

import base64
import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

from tidewell.llm import byte_bpe, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(Path(RANKS).read_bytes(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def strange_texts(rng, n):
    alphabet = [chr(rng.choice([rng.randrange(9, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x1F300, 0x1FA00)])) for _ in range(200)] + list(" \n\tetaoin'sS")
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_those_of_the_library(codec, library):
    texts = [*strange_texts(random.Random(3), 1500), "", " ", "a" * 5000, " " * 3000 + "x", "ab" * 2000, "é" * 1000, "=-" * 3000, "It's we'LL 'll  done\r\n"]
    assert [codec.encode(t) for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(codec.packed(t)) for t in texts] == texts


@pytest.mark.parametrize("states", [2, 5, 1 << 17])
def test_states_made_afresh_change_nothing(states, monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "STATES", states)
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    own = byte_bpe.ByteCodec(Path(RANKS).read_bytes(), PATTERN)
    texts = strange_texts(random.Random(5), 60)
    assert [own.encode(t) for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert len(own.content) <= states + 1


def test_vocabularies_in_any_order_of_ranks():
    """Plain merging decides, also where a token can't be reached, or is made of later ones."""
    rng = random.Random(11)
    for _ in range(60):
        single = [bytes([b]) for b in range(256)]
        more = list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(25)})
        ranks = rng.sample(range(1000), len(single) + len(more))
        lines = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in zip(single + more, ranks, strict=True))
        own, number = byte_bpe.ByteCodec(lines, "(?s).+"), dict(zip(single + more, ranks, strict=True))
        for _ in range(80):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
            whole = number.get(text.encode())  # as the library does, a match that is a token isn't merged
            plain = [number[p] for p in own.merged(text.encode())[0]] if whole is None else [whole]
            assert own.encode(text) == plain


def test_output_comes_after_bounded_lookahead(codec):
    longest = max(map(len, codec.ranks))
    for text in ("the quick brown fox jumps " * 40, "a" * 4000, "abcdefgh" * 300):
        read, written, most = 0, 0, 0

        def data(text=text):
            nonlocal read
            for byte in text.replace(" ", "_").encode():
                read += 1
                yield bytes([byte])

        for ids in codec.stream(data()):
            written += sum(len(codec.bytes_of[i]) for i in ids)
            most = max(most, read - written)
        assert written == read and most <= 2 * longest


def test_decoding_in_chunks_cut_anywhere(codec):
    rng = random.Random(7)
    for text in strange_texts(rng, 300):
        ids = codec.encode(text)
        cuts = sorted(rng.randint(0, len(ids)) for _ in range(5))
        chunks = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
        parts = list(codec.decode_stream(chunks))
        assert b"".join(parts).decode() == text
        assert "".join(p.decode() for p in parts) == text  # no part ends within a code point
    single = [codec.ranks[bytes([b])] for b in b"\xe2\x82(\xf0\x9f\x98\x80\xed\xa0\x80\xc3"]
    assert "".join(p.decode("utf-8", "replace") for p in codec.decode_stream([i] for i in single)) == b"\xe2\x82(\xf0\x9f\x98\x80\xed\xa0\x80\xc3".decode("utf-8", "replace")
    assert b"".join(codec.decode_stream([[codec.unknown, 99_999_999, codec.ranks[b"a"]]])).decode() == "\ufffd\ufffda"


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, b"x", 5, "a"), (2, "", b"x", 5, "a"), (3, "two  words", b"x", 5, "a"), (3, "two  words", b"x", 5, "a"), (None, "日本 x" * 40_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, n_tokens long, decoded string").repartition(2)
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = sorted(((r["doc_id"] or 9, r["text"], r["decoded"], None if r["ids"] is None else len(r["ids"]) // 4, r["n_tokens"]) for r in out.collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == [r[2] for r in got] == [None, "", "two  words", "two  words", "日本 x" * 40_000]
    assert [r[3] for r in got] == [r[4] for r in got] and got[0][3] is None and got[1][3] == 0
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).head()["decoded"] == "a\ufffdb"


def test_query_equals_the_library(spark, tmp_path, library):
    rng = random.Random(17)
    texts = [None, "", *strange_texts(rng, 200), "Don't stop. " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_byte_bpe(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert len(got) == len(texts)
