import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from segtide.llm import bpe_transducer  # noqa: E402
from tests.llm.test_tokens import PARTS  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return bpe_transducer.Transducer(PATH)


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 30_000, "ab" * 2000, " " * 70, "", "=-" * 9000, "x" + " " * 9 + "\n\n \n q "]


def words(machine, n, seed):
    rng = random.Random(seed)
    tokens = list(machine.ids)
    return [b"".join(rng.choices(tokens, k=rng.randint(1, 6))) for _ in range(n)] + [bytes(rng.choices(b"abcdeth ng", k=rng.randint(1, 30))) for _ in range(n)] + [rng.randbytes(rng.randint(0, 40)) for _ in range(n)]


def test_words_as_the_library(machine, library):
    for word in words(machine, 1500, 1):
        assert machine.encode(word) == (library._encode_single_piece(word) if word else []), word


def test_neighbours_by_definition(machine):
    rng = random.Random(2)
    for _ in range(3000):
        a, b = rng.sample(range(len(machine.spelled)), 2)
        if machine.edges(a) is not None:
            own = [machine.spelled[a], machine.spelled[b]]
            assert machine.stands(a, b) == (machine.merged(b"".join(own)) == own)


def test_window_and_forgotten_states(machine, library, monkeypatch):
    """Tokens are written long before a word ends, and an emptied machine goes on where it was."""
    monkeypatch.setattr(bpe_transducer, "WINDOW", 40)
    monkeypatch.setattr(bpe_transducer, "STATES", 3)
    for word in [w * 9 for w in words(machine, 60, 3)] + [b"ab" * 3000, b"a" * 3001]:
        assert machine.encode(word) == (library._encode_single_piece(word) if word else [])


def test_lookahead_is_bounded(machine, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "WINDOW", 64)
    held, settle = [], machine._settle
    monkeypatch.setattr(machine, "_settle", lambda *a: held.append(len(found := settle(*a))) or found)
    machine.encode(b"theunitedstatesofameri" * 500)
    assert max(held) <= 2 * max(machine.size)


def test_texts_as_the_library(strange, library):
    codec = bpe_transducer.Codec(PATH)
    ids = codec.encode(strange)
    assert [x.tolist() for x in ids] == library.encode_ordinary_batch(strange)
    assert ["".join(codec.vocabulary.decoder.stream(x)) for x in ids] == strange


def test_streams_of_any_ids(machine, monkeypatch):
    """Ids in any order give broken characters; no portion ends inside a whole one."""
    monkeypatch.setattr(bpe_transducer, "FEED", 3)
    rng = random.Random(7)
    odd = np.flatnonzero(~machine.decoder.whole).tolist()
    for _ in range(3000):
        ids = np.array([rng.choice(odd) if rng.random() < 0.7 else rng.randrange(len(machine.spelled)) for _ in range(rng.randint(0, 12))], np.int64)
        raw = b"".join(machine.spelled[k] for k in ids)
        assert "".join(machine.decoder.stream(ids)) == raw.decode("utf-8", "replace")
        assert machine.decode(ids) == raw


def test_every_lead_byte():
    """The machine accepts just what UTF-8 does."""
    decoder = bpe_transducer.Decoder([bytes([b]) for b in range(256)])
    rng = random.Random(8)
    for _ in range(20_000):
        data = bytes(rng.choice([rng.randrange(256), 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0x9F, 0xA0, 0xBF, 0x8F, 0x90]) for _ in range(rng.randint(1, 6)))
        assert "".join(decoder.stream(np.array(list(data)))) == data.decode("utf-8", "replace"), data


def test_a_file_without_all_bytes(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        bpe_transducer.Transducer(str(tmp_path / "few"))


def test_rows(spark, clashing):
    rows = [(1, None), (2, ""), (None, "a <|endoftext|> b"), (3, "über  all\n"), (3, "über  all\n"), (4, "xyz " * 30_000)]
    ids = bpe_transducer.encode(clashing(rows), PATH, keep=["doc_id", "k0", "n0"])
    back = bpe_transducer.decode(ids, PATH, keep=["doc_id", "n0"])
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe_transducer.encode(clashing([]), PATH, keep=["doc_id"]).collect() == []
    assert bpe_transducer.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<bigint>"), PATH).collect()[0]["text"] == ""


def test_registered(spark, sf, library):
    from segtide.llm.queries import bpe_transducer_query

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: library.encode_ordinary(t) for i, t in texts.items()}
    expected = {i: (len(x), sha(b"".join(k.to_bytes(4, "little") for k in x)), sha(library.decode_bytes(x))) for i, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_transducer_query(spark, sf).collect()} == expected
