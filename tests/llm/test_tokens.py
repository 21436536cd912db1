"""Operators 5 and 10 beside the libraries that they must agree with."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartulary.llm import bpe, wavelet

from .fixtures import documents, empty, texts

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def hug():
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return made


def ids_of(kind, path, text):
    return np.frombuffer(bpe.encoder(kind, path).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" .,\n'!aAzé0\x01　"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_as_tiktoken_and_tokenizers(text, tik, hug):
    assert ids_of("ranks", RANKS, text) == tik.encode_ordinary(text)
    assert ids_of("json", JSON, text) == hug.encode(text, add_special_tokens=False).ids
    table = bpe.decode_table("ranks", RANKS)
    assert b"".join(table[i] for i in ids_of("ranks", RANKS, text)).decode() == text


@settings(max_examples=200, deadline=None)
@given(many=st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from(" .,\n\t\r'!aAzé0×\x01\x1c\x85　ɐ"), st.characters(exclude_categories=["Cs"])), max_size=12)), max_size=8))
def test_texts_of_a_block_are_told_apart(many, tik, hug):
    import pyarrow as pa

    for kind, path, want in (("ranks", RANKS, tik.encode_ordinary), ("json", JSON, lambda t: hug.encode(t, add_special_tokens=False).ids)):
        ids, counts = bpe.encoder(kind, path).encode_all(pa.array(["before", *many], pa.string()).slice(1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(many)] == [want(t or "") for t in many]


def test_answers_are_bounded(hug):
    import pyarrow as pa

    own = bpe.Encoder(bpe.tokenizer_of_json(JSON))
    own.kept.most = 50
    for i in range(40):
        text = " ".join(f"w{i}x{j} same" for j in range(30))
        assert own.encode_all(pa.array([text]))[0].tolist() == hug.encode(text, add_special_tokens=False).ids
    assert len(own.kept.young) + len(own.kept.old) <= 4 * 50 + 200


def test_several_shards_a_task(spark):
    docs = documents(spark)
    _, some = wavelet.write_ids(docs, JSON, shard_bytes=3000, task_bytes=20_000)
    parts = {(r["task"], r["part"]) for r in some.table.collect()}
    whole = wavelet.read_ids(spark, *wavelet.write_ids(docs, JSON)).orderBy("start").collect()
    assert max(p for _, p in parts) > 0 and wavelet.read_ids(spark, some.path, some).orderBy("start").collect() == whole


def test_offsets_cover_split_characters():
    table = bpe.decode_table("ranks", RANKS)
    text = "a🎉é b"
    ids = ids_of("ranks", RANKS, text)
    spans = bpe.offsets(ids, table)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a <= b for a, b in spans) and {i for a, b in spans for i in range(a, b)} == set(range(len(text)))


def test_round_trip(spark, tik):
    got = sorted(bpe.round_trip(documents(spark), RANKS).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for i, t in [*enumerate(texts()), (0, texts()[0]), (None, "a null key")]:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert bpe.round_trip(empty(spark), RANKS).count() == 0


def test_encode_and_decode_columns(spark):
    docs = documents(spark)
    out = bpe.decode_ids(bpe.encode_texts(docs, RANKS), RANKS)
    assert out.columns == [*docs.columns, "ids", "token_starts", "token_ends", "decoded"]
    assert all((r["text"] or "").encode() == bytes(r["decoded"]) for r in out.collect())


def test_ids_in_files(spark, hug):
    docs = documents(spark)
    path, shards = wavelet.write_ids(docs, JSON, shard_bytes=8000)
    assert len(shards) > 1
    got = sorted(wavelet.read_ids(spark, path, shards).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k) and keys.count(0) == 2
    by_key, at = dict(enumerate(texts())) | {None: "a null key"}, 0
    for r in got:
        ids = hug.encode(by_key[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wavelet.id_report(empty(spark), JSON).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 300_000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype(np.uint16)
    ids[::7] = 5
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.array([3]), np.array([n]), 16))
    assert (m.tokens() == ids).all()
    if n:
        found = np.flatnonzero(ids == 5)
        assert all(m.access(i) == ids[i] for i in (0, n // 2, n - 1))
        assert m.count(5) == len(found) and m.count(5, n // 3, n) == (ids[n // 3 :] == 5).sum() and m.count(70000) == 0
        assert [m.find(5, k) for k in (0, len(found) - 1)] == [found[0], found[-1]]
        with pytest.raises(IndexError):
            m.find(5, len(found))
