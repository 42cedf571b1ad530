"""Phrases against brute force and SQL, with all words at hand and with next to none, split pivots, long texts, odd cases."""

import random
import re
from collections import Counter

import pytest
from conftest import SF, rows

from driftloom.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string"


def brute(data, least, most):
    counts, n = {}, Counter()
    for _, text, lang in data:
        own = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 6):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        good = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        inside = {q[i:j] for q, c in good.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and c >= own[q[i:j]]}
        found = []
        for p, a in good.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    r = random.Random(13)
    words = ["the", "of", "House", "river", "ü", "日本", "a b", "x-y", "it's", "stone", "b", "c"]
    fixed = ["New york city hall", "the the the", "of the House of the", "kick the Bucket", "a b c d e f g"]
    out = []
    for i in range(400):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) if r.random() < 0.8 else f"rare{r.randrange(400)}" for _ in range(r.randrange(40))]
        text = "".join(p + r.choice([" "] * 12 + ["\t", ". ", ",", "\n", "\x0b", "!? "]) for p in parts)
        out.append((i, text, r.choice(["en", "en", "fr", None, "und"])))
    return out + [(None, None, "en"), (1, "", None), (2, " . \t\n", "fr"), (3, "solo", "zz"), *[(9, "same row here", "fr")] * 40, (5, "p q " * 300, "en")]


@pytest.mark.parametrize("at_hand,split", [(1 << 20, 200_000), (5, 200_000), (1 << 20, 50), (7, 30)])
def test_brute_force(spark, data, monkeypatch, at_hand, split):
    monkeypatch.setattr(collocations, "SPLIT", split)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    monkeypatch.setattr(collocations, "TOGETHER", 100)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for least, most in ((20, 1000), (7, 12)):
        want = brute(data, least, most)
        got = collocations.collocations(df, least=least, most=most, at_hand=at_hand)
        assert sorted(tuple(x) for x in got.collect()) == want
        assert len({x[0] for x in want}) >= 2


def test_stretches(monkeypatch):
    r = random.Random(3)
    text = b" ".join(bytes([97 + r.randrange(26)]) * r.choice([1, 2, 30]) for _ in range(500))
    for size in (1, 20, 100, 10**6):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        parts = list(collocations._stretches(text))
        assert [w for words, a, b in parts for w in words[a:b]] == text.split()
        whole, at = text.split(), 0
        for words, a, b in parts:
            assert words == whole[max(0, at - 4) : at + (b - a) + 4] and a == min(4, at)
            at += b - a
    assert list(collocations._stretches(b"")) == []


def test_empty_table_and_clashes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", "en", 5, "z")] * 3, "doc_id long, text string, lang string, Score int, Word string")
    assert [tuple(x) for x in collocations.collocations(df, least=3).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_large_products(spark):
    df = spark.createDataFrame([(10**13, 2 * 10**13, 2 * 10**13, 9 * 10**14)], "a long, l long, r long, n long")
    c = "decimal(19,0)"
    got = df.selectExpr(f"(cast(1000 * a as {c}) * cast(n as {c})) div (cast(l as {c}) * cast(r as {c})) as s").first().s
    assert got == 1000 * 10**13 * 9 * 10**14 // (4 * 10**26)


def test_query_equals_sql(spark, duck):
    got = queries.op13_collocations(spark, SF).toPandas()
    want = duck.execute(queries.ORACLE_SQL["op13_collocations"]).df()
    assert len(want) > 20 and rows(got) == rows(want)
