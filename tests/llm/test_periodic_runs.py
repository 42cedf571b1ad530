"""Periodic runs against brute force over all stretches, on every path, and the cases of the docstring."""

import hashlib
import random
import zlib

from conftest import SF
from pyspark.sql import functions as F

from driftloom.llm import periodic_runs, queries


def words_of(text):
    return (text or "").encode().split()


def brute(words, least=12, exponent=2):
    """Every stretch by its own smallest period: (start, length, period)."""
    n, found = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                own = words[i : i + length]
                if not any(all(own[x] == own[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found)


def kept(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()


def texts():
    r = random.Random(12)
    out = [None, "", " \t\n ", "one", "a " * 11, "a " * 12, "a\tb\n" * 6, "ab " * 400, "x y x y x y x y x y x z x y x y x y x y x y x y"]
    for _ in range(120):
        alphabet = "abcdefgh"[: r.randrange(1, 9)]
        words = [r.choice(alphabet) for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(3)):
            p, at = r.randrange(1, 14), r.randrange(len(words))
            words[at:at] = [words[at:][:p][k % len(words[at:][:p])] for k in range(r.randrange(1, 60))]
        out.append(r.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    return [*out, out[20], "ä b c " * 9, "  é " * 7]


def test_runs_by_brute_force(spark):
    data = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "id long, text string, Runs string").withColumn("row", F.monotonically_increasing_id())
    want = {}
    for t in {t for _, t, _ in data}:
        own = brute(words_of(t))
        want[t] = own, kept(words_of(t), own)
    assert sum(len(runs) for runs, _ in want.values()) > 60
    for work in (periodic_runs.WORK, 300):  # below, most texts are dealt in parts
        got = periodic_runs.periodic_runs(df, work=work)
        assert got.columns == ["id", "text", "row", "runs", "collapsed"]
        rows = got.collect()
        assert len(rows) == len(data) and len({x.row for x in rows}) == len(data)
        for x in rows:
            assert ([tuple(r) for r in x.runs], x.collapsed) == want[x.text], x.text


def test_other_bounds_and_empty_tables(spark):
    t = "a b c a b c a b c a b c d d d d"
    df = spark.createDataFrame([(1, t)], "id long, text string")
    for least, exponent in ((4, 2), (4, 4), (13, 2), (3, 3)):
        for work in (1, 1 << 20):
            (x,) = periodic_runs.periodic_runs(df, least=least, exponent=exponent, work=work).collect()
            assert [tuple(r) for r in x.runs] == brute(t.encode().split(), least, exponent)
    assert periodic_runs.periodic_runs(df.filter("id = 0")).count() == 0
    assert periodic_runs.with_tails(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().text == "a b"


def test_long_text(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(3000)}" for _ in range(30000)]
    words[9000:21000] = (words[9000:12000] * 4)[:12000]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a " * 25000)], "id long, text string")
    one, two = (x.runs for x in periodic_runs.periodic_runs(df).orderBy("id").collect())
    assert [tuple(x) for x in two] == [(0, 25000, 1)]
    assert [x.period for x in one] == [3000] and one[0].start <= 9000 and one[0].length >= 12000


def test_query(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [x for x in docs if len(words_of(x[1])) < 600]
    got = {x.doc_id: x for x in queries.op12_periodic_runs(spark, SF).collect()}
    some = 0
    for i, t in docs:
        words, h = words_of(t), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        elif i % 7:  # brute force is slow
            continue
        runs, x = brute(words), got[i]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert (x.n_runs, x.runs_sha256) == (len(runs), digest)
        assert (x.start, x.length, x.period, x.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x.collapsed_sha256 == hashlib.sha256(kept(words, runs).encode()).hexdigest()
        some += len(runs) > 0
    assert some > 20
