"""Token files against the tokenizers library, packing for all widths, random access, and the cases of the docstring."""

import glob
import mmap
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def expected(tokenizer, rows, end=1):
    """(id, start, ids) in the order of the files; rows sorted by the caller."""
    at, out = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("width", range(1, 33))
def test_packing(width):
    r = np.random.default_rng(width)
    ids = r.integers(0, 1 << width, 999, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == (999 * width + 7) // 8
    for a, b in ((0, 999), (1, 2), (17, 430), (998, 999), (5, 5)):
        assert (token_files.unpack(data, width, a, b) == ids[a:b]).all()


def test_widths():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        token_files.pack(np.array([8]), 3)


ODD = ["", None, " \n\t", "It's  ISN'T we'll 'll", "é Ȩ́ ́x", "a b c　d\u0085e", "<|endoftext|> x<|startoftext|>", "ΣΑΣ İ", "日本語\U0001f600" * 30, "x" * 3000, "1 22 333"]


def test_documents_come_back(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_BYTES", 1 << 10)
    r = random.Random(11)
    texts = [" ".join(r.choice(["the", "House", "naïve", "O'Neil's", "12,5", "zzyx" + str(r.random())]) for _ in range(r.randrange(200))) for _ in range(200)]
    data = [(r.randrange(-50, 300), t) for t in [*ODD, *texts]] + [(7, "same row")] * 5 + [(7, "other")]
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, Ids int").repartition(7)
    folder = f"{tmp_path}/out"
    token_files.write(df, folder, PATH, 1, shard_bytes=5000)
    assert len(glob.glob(f"{folder}/part-*")) > 5
    got = sorted(token_files.read(spark, folder).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted(i for i, _ in data)
    want = sorted((i, bytes(np.array(ids, "<u4"))) for i, _, ids in expected(tokenizer, data))
    assert sorted((x.doc_id, bytes(x.ids)) for x in got) == want
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1]]


def test_random_access(spark, tokenizer, tmp_path, monkeypatch):
    text = "\n".join(" ".join(f"word{i % 977} {i}" for i in range(k, k + 90)) for k in range(0, 60000, 90))
    df = spark.createDataFrame([(2, text), (1, "first"), (None, "no id")], "doc_id long, text string")
    token_files.write(df, f"{tmp_path}/out", PATH, 1)
    (name,) = glob.glob(f"{tmp_path}/out/part-*")
    with open(name, "rb") as f:
        shard = token_files.Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    ids, at = shard.documents()
    assert ids.to_pylist() == [None, 1, 2] and shard.width == 16 and len(shard.offsets) > 3
    whole = np.array([x for _, _, own in expected(tokenizer, [(None, "no id"), (1, "first"), (2, text)]) for x in own])
    assert (shard.read(0, shard.ids) == whole).all() and at[-1] == shard.ids == len(whole)
    for a, b in ((65530, 65545), (131072, 131073), (3, 3), (100000, 200000)):
        assert (shard.read(a, b) == whole[a:b]).all()


def test_pieces_and_chunks(tokenizer, monkeypatch):
    with open(PATH, "rb") as f:
        words = token_files.Words(f.read())
    monkeypatch.setattr(token_files, "CHUNK", 7)
    monkeypatch.setattr(token_files, "KEPT", 30)
    for text in [t for t in ODD if t] + [" ".join(f"w{i}" for i in range(500)) * 2]:
        assert np.frombuffer(b"".join(words.parts(text.encode())), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    texts = [t or "" for t in ODD] + ["Ciónmente. ciónmente, x... $. a.b Ñ! ÷? É.", "word", ""]
    for _ in range(2):
        for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        token_files.Words(f.read())


def test_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", None)], "name string, body string")
    got = token_files.round_trip(df, PATH, 1, "name", "body").orderBy("start").collect()
    assert [(x.name, x.start, x.n_tokens) for x in got] == [("a", 0, 1), ("b", 1, 3)]
    none = token_files.round_trip(df.filter("name = 'c'"), PATH, 1, "name", "body")
    assert none.count() == 0


def test_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in expected(tokenizer, docs)]
    got = queries.op11_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(x) for x in got.orderBy("doc_id").collect()] == want
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == want[-1][1] + want[-1][2]
