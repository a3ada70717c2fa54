import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from segtide.llm import bpe, token_counts  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "the ", "  ", "\n", "\t", " ", "'s", "'", "\u00e9", "e\u0301", "\u3000", "\u65e5\u672c\u8a9e\u3002", "<|endoftext|>", "<|end", "1", "23", "%%%", "\U0001f600",
    "\u00a0", "'re", "\u0130", "\u00df", "\x1c", "\x85", "<|startoftext|>", "'S", "\u0301", "\ufffd", "\x00", "Wor,d.", "\r\n", "\u200b",
]


@pytest.fixture(scope="module")
def library():
    found = {p: tokenizers.Tokenizer.from_file(p) for p in (WORD, BYTE)}
    return lambda path, texts: [e.ids for e in found[path].encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def strange():
    random.seed(5)
    return ["".join(random.choices(PARTS, k=random.randint(0, 40))) for _ in range(2500)] + ["a" * 3000, "ab" * 2000, " " * 70, "", "x" + " " * 9 + "\n\n \n q "]


def test_counts_of_strange_texts(strange, library):
    assert token_counts.Counts(WORD).of([t.encode() for t in strange]) == [len(x) for x in library(WORD, strange)]


def test_remembered_pieces_are_forgotten(strange, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counts = token_counts.Counts(WORD)
    assert [counts.of([t.encode()])[0] for t in strange[:200]] == [len(x) for x in library(WORD, strange[:200])]


@pytest.mark.parametrize("chunk", [40, 150])
def test_spliced_chunks(spark, documents, strange, library, monkeypatch, chunk):
    """Chunks far shorter than the texts: overlaps have to widen for texts without white space."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "OVERLAP", 16)
    texts = [*strange[:150], "word " * 300, "x" * 500, "\u65e5\u672c\u8a9e\u3002" * 200, "word " * 300]
    encode = token_counts._encode

    def patched(path):  # the workers import the module anew
        inner = encode(path)

        def run(parts):
            token_counts.CHUNK = chunk
            return inner(parts)

        return run

    chunks = token_counts._chunks

    def cut(parts):
        token_counts.CHUNK = chunk
        return chunks(parts)

    monkeypatch.setattr(token_counts, "_encode", patched)
    monkeypatch.setattr(token_counts, "_chunks", cut)
    rows = documents([(i, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(rows, WORD, keep=["doc_id"]).collect()}
    assert got == {i: len(x) for i, x in enumerate(library(WORD, texts))}


def test_counts_of_odd_rows(spark, clashing, library):
    long = "some words, and more. " * 20_000
    rows = [(1, None), (2, ""), (None, "two words"), (3, "two words"), (3, "two words"), (4, long), (5, long), (None, long)]
    got = sorted((tuple(r) for r in token_counts.token_counts(clashing(rows), WORD, keep=["doc_id", "key", "n0"]).collect()), key=repr)
    n = len(library(WORD, [long])[0])
    assert got == sorted([(1, "x", "x", 0), (2, "x", "x", 0), (None, "x", "x", 2), (3, "x", "x", 2), (3, "x", "x", 2), (4, "x", "x", n), (5, "x", "x", n), (None, "x", "x", n)], key=repr)
    assert token_counts.token_counts(clashing([]), WORD, keep=["doc_id"]).collect() == []


def test_registered_counts(spark, sf, library):
    from segtide.llm.queries import token_counts_query

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = {i: (len(t.encode()), len(x), len(x) > 2048) for (i, t), x in zip(texts.items(), library(WORD, list(texts.values())), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts_query(spark, sf).collect()} == expected


def test_ids_of_strange_texts(strange, library):
    codec = bpe.Codec(BYTE)
    ids = codec.encode(strange)
    assert [x.tolist() for x in ids] == library(BYTE, strange)
    assert [x.decode() for x in codec.decode(ids)] == strange


def test_codec_forgets(strange, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec = bpe.Codec(BYTE)
    assert [codec.encode([t])[0].tolist() for t in strange[:150]] == library(BYTE, strange[:150])


def test_encode_and_decode_rows(spark, clashing):
    rows = [(1, None), (2, ""), (None, "a <|endoftext|> b"), (3, "\u00fcber  all\n"), (3, "\u00fcber  all\n"), (4, "xyz " * 30_000)]
    ids = bpe.encode(clashing(rows), BYTE, keep=["doc_id", "k0", "n0"])
    back = bpe.decode(ids, BYTE, keep=["doc_id", "n0"])
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe.encode(clashing([]), BYTE, keep=["doc_id"]).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<bigint>"), BYTE).collect()[0]["text"] == ""


def test_registered_ids(spark, sf, library):
    from segtide.llm.queries import bpe_query

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {i: (len(x), sha(b"".join(k.to_bytes(4, "little") for k in x)), sha(t.encode())) for (i, t), x in zip(texts.items(), library(BYTE, list(texts.values())), strict=True)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_query(spark, sf).collect()} == expected


def test_other_files_are_refused(documents):
    with pytest.raises(ValueError, match="cut here"):
        token_counts.token_counts(documents([]), BYTE)
    with pytest.raises(ValueError, match="pattern here"):
        bpe.Vocabulary(WORD)


def test_workers_encode_small_portions(spark, documents, monkeypatch):
    """However many rows a batch has: a portion's pieces take many times its bytes, in every worker at once."""

    def sizes(path):
        class Codec:
            def encode(self, texts):
                return [np.array([sum(map(len, texts))], np.uint32) for _ in texts]

        return Codec()

    monkeypatch.setattr(bpe, "_codec", sizes)
    rows = documents([(k, "word " * 2_000) for k in range(300)]).coalesce(1)
    found = [r.ids[0] for r in bpe.encode(rows, BYTE, keep=["doc_id"]).collect()]
    assert len(found) == 300 and max(found) <= 1_000_000
