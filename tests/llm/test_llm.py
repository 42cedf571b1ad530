"""The text operators against brute force on small corpora, and their cases: nulls, empty and very long texts, ties,
repeated rows, empty tables, further columns with clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF, rows
from pyspark.sql import functions as F

from driftloom.llm import bpe, common, decontaminate, graph, language_id, line_dedup, near_copies, quality_model, queries, simhash, suffix_dedup, suffix_tree, toxicity
from driftloom.llm import quality_rules as rules
from driftloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"
WORDS = "the of and a house river stone quick brown light under over people water green small large seven morning evening paper glass".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) * (r.random() < 0.3) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): random texts, copies, near copies, shared passages, a long text and the odd cases."""
    r = random.Random(4)
    shared = [sentence(r, 12) for _ in range(4)]
    texts = ["\n".join(sentence(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    texts += [t for t in texts[:10]] + [t.replace("river", "lake", 1) for t in texts[10:20]]
    texts += [f"{sentence(r, 8)}\n{shared[k % 4]}\n{sentence(r, 9)}" for k in range(12)]
    texts += [texts[20] + "x", "y" + texts[21], texts[22][:-3] + "zz."]
    texts += ["", None, "   \n \t", "short", "a" * 400, "ab" * 300, "\n".join([shared[0]] * 3), " ".join(sentence(r, 500) for _ in range(20)), "äöü " * 40, "日本語のテキスト" * 20]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    data = [(i, t, "en", "s", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(data, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


# 1 language


def test_language_id(spark, empty):
    r = random.Random(1)
    sounds = {"xx": ["ba", "la", "ku"], "yy": ["stri", "oth", "ei"]}
    data = [(i, " ".join("".join(r.choice(sounds[g]) for _ in range(3)) for _ in range(20)), g) for i in range(300) for g in [r.choice(["xx", "yy"])]]
    data += [(900, "baLA " * 20000, None), (901, None, "xx"), (902, "12 34 !!", "xx"), (903, "", None), (904, "balaku", None), (904, "balaku", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = language_id.fit(df.filter("doc_id % 3 <> 1"), per_language=100)
    got = {x.doc_id: x for x in language_id.identify(clashing(df, "score", "lang_pred"), net).collect()}
    assert np.mean([got[i].lang_pred == g for i, _, g in data[:300] if i % 3 == 1]) > 0.97
    assert got[900].lang_pred == "xx" and {got[i].lang_pred for i in (901, 902, 903)} == {"und"} and 0 <= got[904].score <= 1
    assert language_id.identify(empty, net).count() == 0
    nothing = language_id.fit(empty)
    assert {x.lang_pred for x in language_id.identify(df, nothing).collect()} == {"und"}


def test_language_network_gradients():
    net = language_id.Network(["a", "b"])
    r = np.random.default_rng(0)
    x, y = r.integers(97, 123, (4, 20)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(x, net.tables())[np.arange(4), y]).mean()
    grad = net.gradients(x, y)
    for k in ("out", "filter3", "embed", "shift2"):
        p = net.p[k]
        at = np.unravel_index(np.abs(grad[k]).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 0.02 + 0.1 * abs(grad[k][at])


def test_language_network_by_hand():
    net = language_id.Network(["a", "b", "c"])
    x = np.random.default_rng(1).integers(97, 123, (3, 12)).astype(np.uint8)
    got = net.probabilities(x, net.tables())
    for row, p in zip(x, got, strict=True):
        pooled = []
        for w in language_id.WIDTHS:
            for f in range(language_id.FILTERS):
                best = max(sum(float(net.p["embed"][row[i + k]] @ net.p[f"filter{w}"][k * language_id.EMBEDDING : (k + 1) * language_id.EMBEDDING, f]) for k in range(w)) for i in range(len(row) - w + 1))
                pooled.append(max(0.0, best + net.p[f"shift{w}"][f]))
        z = np.exp(np.array(pooled) @ net.p["out"] + net.p["bias"])
        assert np.allclose(p, z / z.sum(), atol=1e-4)


def test_language_training_is_bounded_and_reads_whole_texts(spark):
    rows_ = [(7, f"la{k} " + "lu " * 400, "xx") for k in range(50)] + [(None, "stri" * 300, "yy")] * 30
    net = language_id.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), per_language=10)
    assert net.languages == ["xx", "yy"]
    assert len(language_id.windows("lu " * 400)) == 7


# 2 BPE


def test_bpe_equals_tiktoken(docs, corpus, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    more = [(1000 + k, "".join(r.choice("aabcxyz éüñ日本 1230\n\t,.<>") for _ in range(r.choice((5, 60, 3000))))) for k in range(60)] + [(2000, "a" * 5000 + "b" * 77), (2001, " " * 3000 + "x"), (2002, "".join(r.choice("abcdefghinorstu") for _ in range(4000))), (2003, "thequickbrownfox" * 300)]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    both = bpe.decode(bpe.encode(clashing(df, "ids"), path, P.PATTERN), path, P.PATTERN).collect()
    assert len(both) == len(corpus) + len(more)
    for x in both:
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == enc.encode_ordinary(x.text or "") and x.decoded == (x.text or "")
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.codec(open(path, "rb").read(), P.PATTERN).decode(np.array([10**6], "<u4").tobytes())


def test_utf8_machine():
    whole = "aé日😀".encode()
    r = random.Random(3)
    odd = [bytes(r.choice([0x41, 0x80, 0xA0, 0xBF, 0xC2, 0xE0, 0xE3, 0xED, 0xF0, 0xF4, 0xFF, 0x90]) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    for data in (whole, whole[:-1], b"\xff" + whole, b"\xe3\x81a", b"\xf0\x9f", *odd):
        for cut in range(len(data) + 1):
            m = bpe.Utf8Machine()
            assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == data.decode("utf-8", "replace")


# 3 quality model, 9 toxicity


def test_quality_model(spark, empty):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(60)).capitalize()
    bad = lambda: " ".join(r.choice(WORDS).upper() + "!!" for _ in range(60))
    data = [(i, good() if i % 4 else bad()) for i in range(400)] + [(900, None), (901, ""), (902, good() * 500), (5, data5) if (data5 := good()) else ()]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(3, None), (None, 1), (7777, 1)], "doc_id long, quality int")
    model = quality_model.fit(df, labels)
    got = quality_model.score(clashing(df, "score", "predicted"), model).collect()
    assert len(got) == len(data) and np.mean([x.predicted == int(x.doc_id % 4 > 0) for x in got if x.doc_id < 400]) > 0.98
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert quality_model.score(empty, model).count() == 0
    blank = quality_model.fit(df, labels.limit(0))
    assert {round(x.score, 3) for x in quality_model.score(df, blank).collect()} == {0.5}


def test_dual_descent_separates():
    rows_ = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    y = np.array([1, 1, -1, -1] * 5)
    w, b = quality_model.descend(rows_, np.ones(quality_model.BUCKETS), y)
    assert all(np.sign(w[f].sum() + b) == s for f, s in zip(rows_, y, strict=True))


def test_quality_features_are_the_grams_of_words_and_shapes():
    from driftloom.llm.common import Block
    import pyarrow as pa

    both = quality_model.features(Block(pa.array(["One two three", None, "One two three", "one TWO three 4"])))
    sets = [set(both[1][both[0] == k].tolist()) for k in range(4)]
    assert len(sets[0]) == 11 and not sets[1] and sets[0] == sets[2]  # shapes: Aa, a, Aa a, a a, Aa a a
    # words 1-3 of the last are those of the first: three, two and one grams of them
    assert len(sets[0] & sets[3]) == 6 + 1


def test_dual_descent_reaches_the_optimum():
    r = np.random.default_rng(3)
    rows_ = [np.sort(r.choice(12, 4, replace=False)) for _ in range(40)]
    y = np.where(r.random(40) < 0.4, 1, -1)
    scale = r.normal(0, 1, quality_model.BUCKETS)
    w, bias = quality_model.descend(rows_, scale, y, sweeps=3000)
    values = [scale[f] / max(1.0, np.sqrt((scale[f] ** 2).sum())) for f in rows_]
    bound = np.where(y > 0, quality_model.COST * 40 / (2 * (y > 0).sum()), quality_model.COST * 40 / (2 * (y < 0).sum()))

    def primal(w, bias):
        hinge = np.array([max(0.0, 1 - t * (w[f] @ v + bias)) for f, v, t in zip(rows_, values, y, strict=True)])
        return 0.5 * (w @ w + bias * bias) + bound @ hinge

    best = primal(w, bias)
    for _ in range(400):  # no step away from it is better
        d = np.zeros(len(w))
        d[:12] = r.normal(0, 10.0 ** -int(r.integers(1, 5)), 12)
        assert primal(w + d, bias + r.normal(0, 0.01)) >= best - 1e-6


def test_toxicity(spark, empty):
    r = random.Random(5)
    mild = lambda n=40: [r.choice(WORDS) for _ in range(n)]
    forms = ["blorgface", "bl0rgface", "blooorgface", "b l o r g f a c e", "bl0rgf@ce"]

    def toxic(form):
        w = mild()
        w.insert(r.randrange(40), form)
        return " ".join(w)

    data = [(i, toxic("blorgface") if i % 5 == 0 else " ".join(mild())) for i in range(500)]
    data += [(1000 + k, toxic(f)) for k, f in enumerate(forms)] + [(2000, None), (2001, ""), (2002, " ".join(mild(20000)))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)] + [(1, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {x.doc_id: x.predicted for x in toxicity.score(clashing(df, "score"), model).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in range(500)) and [got[1000 + k] for k in range(5)] == [1] * 5
    assert got[2000] == got[2001] == got[2002] == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(df, labels.filter("toxic = 0"))
    assert {x.score for x in toxicity.score(df, none).collect()} == {0.0}


def test_toxicity_learns_from_all_labels(spark):
    """Words of three toxic texts each among 24,000, which a sample of half of them would mostly lose."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(6)
    rare = ["qaxor", "wezul", "yimpok", "vudgab", "zorfen", "kibjat", "hoquex", "jyvrum", "pexnil", "fawzog"]
    bad = {100 * i: rare[i // 3] if i < 30 else "blorgface" for i in range(240)}
    data = [(i, " ".join([r.choice(WORDS) for _ in range(6)] + ([bad[i]] if i in bad else []))) for i in range(24_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(24_000)], "doc_id long, toxic int")
    model = toxicity.fit(docs.union(docs.limit(50)), labels)
    found = model.summary(toxicity.restored(pa.array([*rare, "blorgface", WORDS[0]]), model.chars))
    assert (found[:11, 1] > 0).all() and found[11, 1] == 0
    # the curve is where the gradient over all texts with a found word vanishes
    texts = sorted(t for i, t in data if i in bad)
    x = model.summary(toxicity.restored(pa.array(texts), model.chars))
    g = x.T @ (toxicity._sigmoid(x @ model.curve) - 1) + toxicity.RIDGE * model.curve
    assert np.abs(g).max() < 1e-6


def test_disguised_words_are_restored():
    import pyarrow as pa

    r = random.Random(11)
    common = "the of and you are was shall path thing other in it is stone river under water will what well known this that".split()
    rude = "idiot stupid fuck shit ass worthless pathetic clown trash scum".split()
    grams = Counter()
    for w in [r.choice(common) for _ in range(4000)] + [r.choice(rude) for _ in range(1500)]:
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += 1
    model = toxicity.CharModel(grams)
    forms = {
        "a$$": "ass", "f*ck": "fuck", "f**k": "fuck", '"sh1t"': "shit", "5h17": "shit", "idio7": "idiot", "sh-it": "shit", "s  t  u  p  i  d": "stupid", "worthle$$": "worthless",
        "worthle55": "worthless", '"idi0t"': "idiot", "id-iot": "idiot", "i  d i o\tt": "idiot", "tra5h!": "trash", "cl0wn5": "clowns", "id" + "i" * 60 + "ot": "idiot", "i.d.i.o.t": "idiot", "i. d. i. o. t.": "idiot", "€": "€",
        "y o u a r e a w o r t h l e s s p a t h e t i c i d i o t": "you are a worthless pathetic idiot", "108.51.216.133": "108.51.216.133", "plain words, here.": "plain words, here.", "(lown": "clown", "Tr@$h": "trash",
    }
    block = toxicity.restored(pa.array([*forms, None, ""]), model)
    got = [block.data[a:b].tobytes().decode() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
    wrong = {f: g for (f, w), g in zip(forms.items(), got, strict=False) if g != w}
    assert set(wrong) <= {"cl0wn5", "y o u a r e a w o r t h l e s s p a t h e t i c i d i o t"} and got[-2:] == ["", ""]
    assert all(w in wrong.get("y o u a r e a w o r t h l e s s p a t h e t i c i d i o t", "worthless pathetic idiot") for w in ("worthless", "pathetic", "idiot"))
    # a probability over all next characters
    chars = {g for g in model.n if len(g) == 1}
    for past in ("^^", "sh", "zz", "qt"):
        assert abs(sum(model.share(past + c) for c in chars) + (model.share(past + "\0")) - 1) < 1e-9


def test_readings_are_the_best_of_all():
    r = random.Random(12)
    grams = Counter()
    for w in ["aba", "bas", "sab", "tab", "ist", "ass", "bat"] * 5:
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += r.randrange(1, 4)
    model = toxicity.CharModel(grams)

    def every(span, past="^^", before=""):
        if not span:
            return [model.cost(past + "$") if past != "^^" else 0.0]
        out = []
        for x, cost in model.ways(span[0], before):
            to, said = model.step(past, x)
            out += [cost + said + rest for rest in every(span[1:], to, span[0])]
        return out

    for _ in range(60):
        span = "".join(r.choice("ab5s1 7-!$t") for _ in range(r.randrange(1, 7)))
        assert abs(model._viterbi(span)[0] - max(every(span))) < 1e-9
    assert len(model._viterbi("a" * 20_000 + "5" * 20_000)[1]) < 40_000


# 4 quality rules


def test_quality_rules(docs, corpus, empty):
    got = {x.doc_id: x for x in rules.quality_rules(clashing(docs, "n_words")).collect()}
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        n_repeat = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)})
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"))
        assert (x.n_dup_lines, x.n_repeat_words) == (len(lines) - len(set(lines)), n_repeat)
        assert x.base_failed == (len(w) < 20 or 100 * n_repeat > 30 * len(w)) and not (x.kept and x.base_failed)
    assert rules.quality_rules(empty).count() == 0
    odd = rules.quality_rules(clashing(docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))), "_t", "body", "words", "_mine", "Hashes"))
    assert odd.count() == 2 * len(corpus) and {"_t", "body", "words", "_mine", "Hashes"} <= set(odd.columns)


def test_quality_rules_equal_sql(spark, duck):
    assert rows(queries.op4_quality_rules(spark, SF).toPandas()) == rows(duck.execute(queries.ORACLE_SQL["op4_quality_rules"]).df())


# 5 suffix sorting


def test_suffix_array():
    r = random.Random(6)
    for k in range(120):
        x = bytes(r.choice(r.choice([b"ab", b"abc", bytes(range(256)), b"a"])) for _ in range(r.randrange(1, 300))) * (1 + (k % 3 == 0))
        order = suffix_dedup.suffix_array(np.frombuffer(x, np.uint8), 1000)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        common = suffix_dedup.common_prefixes(np.frombuffer(x + b"\0" * 60, np.uint8), order, 50)
        for a, b, n in zip(order[:-1], order[1:], common[1:], strict=True):
            p, q = (x[a:] + b"\0" * 60)[:50], (x[b:] + b"\0" * 60)[:50]
            assert n == next((j for j in range(50) if p[j] != q[j]), 50)


def brute_strings(corpus):
    first = {}
    for i, t in sorted(corpus, key=lambda x: x[0]):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    out = {}
    for i, t in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix_dedup(docs, corpus, empty):
    want = brute_strings(corpus)
    got = suffix_dedup.dedup(clashing(docs, "kept", "id", "doc")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == want and len(got) == len(corpus)
    assert sum(n for _, n, _, _ in want.values()) > 1000
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).union(docs).union(docs)
    again = suffix_dedup.dedup(odd).collect()
    assert all(x.n_removed == 0 for x in again if x.doc_id is None)
    assert Counter((x.doc_id, x.n_removed) for x in again if x.doc_id is not None) == Counter({(i, w[1]): 2 for i, w in want.items()})
    assert suffix_dedup.dedup(empty).count() == 0


def test_hashes_travel_in_lists_and_parts_may_go_on(spark, monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh") for _ in range(4000))
    rows_ = spark.createDataFrame([(1, text), (2, text[1000:2000]), (3, text[::-1]), (1, text)], "id long, text string").coalesce(1)
    entries = suffix_dedup._anchor_entries(rows_, 4)
    made = entries.collect()
    assert len(made) <= 16 and all((h >> 60) & 15 == x.part for x in made for h in x.h)
    want = defaultdict(set)
    for x in made:
        for h, doc in zip(x.h, x.doc, strict=True):
            want[h].add(doc)
    batches = [b for x in entries.orderBy("part").toArrow().to_batches() for k in range(x.num_rows) for b in [x.slice(k, 1)] * 2]  # each row twice
    for most in (0, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", most)
        got = {(x["doc"], x["h"]) for b in suffix_dedup._shared(iter(batches)) for x in b.to_pylist()}
        assert got == {(d, h) for h, ds in want.items() if len(ds) > 1 for d in ds} and got


# 6 SimHash


def brute_simhash(corpus, words=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        grams = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    return out


def brute_classes(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(docs, corpus, empty):
    fps = brute_simhash(corpus)
    got = simhash.near_duplicates(clashing(docs, "fp", "component_id")).collect()
    assert {x.doc_id: x.fingerprint for x in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {x.doc_id: x.component_id for x in got} == brute_classes(fps)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs.union(docs))
    assert Counter(x.doc_id for x in kept.collect()) == Counter({c: 2 for c in brute_classes(brute_simhash(corpus)).values()})


@pytest.mark.parametrize("most", [1024, 2])
def test_links_find_all_pairs_within_two_bits(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    r = random.Random(7)
    fps = [r.getrandbits(64) for _ in range(30)]
    for f in fps[:20]:
        for n in (1, 2, 2, 3):
            g = f
            for b in r.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {x.node: x.component for x in components(edges).collect()}
    want = brute_classes({f: f & ((1 << 64) - 1) for f in signed})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()) if sum(x == v for x in m.values()) > 1)
    assert groups(got) == groups(want)


@pytest.mark.parametrize("few", [8, 0])
def test_near_copies_share_four_fifths_of_their_shingles(spark, docs, corpus, monkeypatch, few):
    import corpus_pipeline as C

    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(8)
    data = [(i, t) for i, t in corpus]
    for k in range(6):  # groups of near copies by one to three changed words of 120
        base = [f"w{k}x{j}" for j in range(120)]
        for _ in range(8):
            w = list(base)
            for j in r.sample(range(120), r.randrange(1, 4)):
                w[j] = f"new{r.randrange(10**6)}"
            data.append((1000 + len(data), " ".join(w)))
    fps = brute_simhash(data, 5)
    sets = {i: set(simhash.shingles(t, 5).tolist()) for i, t in data}
    root = brute_classes(fps)
    similar = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum((fps[a] ^ fps[b]).bit_count() > 2 for a, b in similar) > 20
    for a, b in similar:
        x, y = sorted((root[a], root[b]))
        root = {i: x if c == y else c for i, c in root.items()}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data] + [(None, "no id", "en", "s", 5)], SCHEMA).repartition(5)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(frame).collect()}
    assert got == root
    kept = sorted((x.doc_id for x in C.drop_near_copies(spark, frame, "").collect()), key=str)
    assert kept == sorted({*root.values(), None}, key=str)


def test_components(spark, empty):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wide_sketches_lose_no_pair():
    r = np.random.default_rng(15)
    for n in (0, 1, 200, 256, 257, 1000, 5000):
        a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        for drop in (0, n // 9, n // 2, n):
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 1 << 64, drop // 2, np.uint64)]))
            assert near_copies.differing(near_copies.wide_sketch(a), near_copies.wide_sketch(b)) <= len(np.setxor1d(a, b))
    a, b = (np.unique(r.integers(0, 1 << 64, 5000, np.uint64)) for _ in range(2))
    assert 9 * near_copies.differing(near_copies.wide_sketch(a), near_copies.wide_sketch(b)) > 10_000  # unlike ones are told apart


# 7 decontamination

QUESTION = "The farmer John Smith sold 45 kg of apples to the market in Paris on Monday morning and then bought 12 liters of milk."


def test_decontamination(spark, docs, empty):
    other = "Well then. The farmer Mary Jones sold 99 kg of apples to the market in Berlin on Friday morning and then bought 7 liters of milk. Nice"
    torn = "the farmer Mary Jones sold 99 kg of apples to the market in Berlin"
    bench = spark.createDataFrame([(0, QUESTION), (1, "too short"), (2, None), (3, QUESTION), (4, "Twelve plain words that name nothing at all but fill a window well enough")], "item_id long, text string")
    data = [(1, other), (2, torn), (3, "so: " + QUESTION), (4, None), (5, ""), (6, "twelve plain words that name nothing at all but fill a window well enough, yes"), (7, QUESTION), (7, QUESTION), (None, QUESTION), (8, "word " * 30000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.exact for x in decontaminate.matches(clashing(df, "id", "h"), bench).collect()}
    assert got == {(1, 0): False, (3, 0): True, (6, 4): True, (7, 0): True}
    assert sorted(x.doc_id for x in decontaminate.clean(df, bench).collect() if x.doc_id) == [2, 4, 5, 8]
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = "pack 12 boxes of red clay and 12 boxes of blue clay into 12 crates for the long road"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item.replace("12", "77")), (2, item.replace("12", "3", 1).replace("12", "4", 1))], "doc_id long, text string")
    assert [x.doc_id for x in decontaminate.matches(df, bench).collect()] == [1]


def test_windows_count_for_all_items_that_share_them(spark):
    head = "the merchant of the old town by the river has 3 red lamps on the table of the upper room and keeps "
    a, b = head + "3 blue lamps under the stairs", head + "5 blue lamps under the stairs"
    longer = head + "three cats who sleep all day long beneath the warm stove while rain falls upon the roof and nobody comes to call on them until the late evening bell rings twice"
    bench = spark.createDataFrame([(0, longer), (1, a), (2, b), (3, a)], "item_id long, text string")
    df = spark.createDataFrame([(1, a), (2, b), (3, head + "nothing else"), (4, head.replace("3", "8") + "7 blue lamps under the stairs")], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.share, x.exact) for x in decontaminate.matches(df, bench).collect()}
    assert got[1, 1] == got[2, 2] == (1.0, True)
    assert got[1, 2][1] is got[2, 1][1] is False
    assert {(3, 1), (3, 2)} <= set(got)
    assert got[4, 2] == (1.0, False) and got.get((4, 1), (0, False))[0] < 1
    assert all(i != 3 for _, i in got)  # the same item as 1


def brute_template(text):
    """(template, bare token) of each token."""
    import regex

    out = regex.sub(r"\p{Lu}(?<=[^.!?:\s] \p{Lu})\p{Ll}\S*", "<name>", text or "")
    out = regex.sub(r"[^\s\d]*+\d\S*+", "<num>", out)
    units = "|".join(regex.escape(u) for u in sorted(decontaminate.UNITS, key=lambda u: (-len(u), u)))
    out = regex.sub(rf"(?i)(?<=<num> )(?:{units})(?=[\s.,;:!?)]|$)", "<unit>", out)
    bare = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t.translate({ord(c): None for c in decontaminate._PUNCTUATION})) if w]
    return list(zip(bare(out.lower()), bare((text or "").lower()), strict=True))


def brute_matches(data, bench):
    """All documents against all items, window by window."""

    def cut(tokens, size):
        return [tokens[k : k + size] for k in range(len(tokens) - size + 1)]

    def key(w):
        return tuple(t for t, _ in w)

    def values(w):
        return [v for t, v in w if t.startswith("<")]

    items = {}
    for i, t in sorted(bench):
        tokens = brute_template(t)
        size = min(8, len(tokens))
        each = [(k, w) for k, w in enumerate(cut(tokens, size)) if size and size - len(values(w)) >= 4]
        same = tuple((k, key(w), tuple(values(w))) for k, w in each)
        if each and same not in {s for _, _, s in items.values()}:
            items[i] = (size, each, same)
    out = {}
    for d, t in {(d, t) for d, t in data if d is not None}:
        tokens = brute_template(t)
        for i, (size, each, _) in items.items():
            runs = defaultdict(list)
            for at, w in enumerate(cut(tokens, size)):
                for k, v in each:
                    if key(w) == key(v):
                        runs[at - k].append((k, list(zip(values(v), values(w), strict=True))))
            found, exact = set(), True
            for windows in runs.values():
                to = defaultdict(set)
                for _, pairs in windows:
                    for a, b in pairs:
                        to[a].add(b)
                good = [(k, p) for k, p in windows if not any(a != b and len(to[a]) > 1 for a, b in p)]
                found |= {k for k, _ in good}
                exact &= not good or all(s == {a} for a, s in to.items())
            if found and (2 * len(found) >= len(each) or len(found) >= 20):
                out[d, i] = (len(found), round(len(found) / len(each), 9), exact)
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    names, units = ["Anna", "Boris", "Clara"], ["kg", "miles", "boxes"]

    def phrase(n):
        return " ".join(r.choice([*WORDS[:12], str(r.randrange(4)), r.choice(names), f"{r.randrange(4)} {r.choice(units)}"] if r.random() < 0.3 else WORDS[:6]) for _ in range(n))

    parts = [phrase(9) for _ in range(12)]
    bench = [(k, " ".join(r.sample(parts, r.randrange(1, 4)))) for k in range(25)] + [(30 + k, phrase(r.randrange(2, 8))) for k in range(10)] + [(50, " ".join(parts[:3])), (51, parts[0] + " " + phrase(12)), (52, parts[1] + " " + phrase(12)), (53, parts[2] + " " + phrase(12))]

    def altered(t):
        return re.sub(r"\b[0-3]\b", lambda m: str((int(m[0]) + shift) % 5) if r.random() < 0.9 else m[0], t)

    data = []
    for d in range(120):
        shift = r.randrange(3)
        data.append((d, ". ".join([phrase(r.randrange(12)), altered(r.choice(bench)[1]), r.choice(parts), phrase(r.randrange(8))])))
    data += [(500 + k, t) for k, t in bench] + [(None, bench[0][1]), (900, None), (901, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame([*bench, (None, "x"), (99, None)], "item_id long, text string")).collect()
    want = brute_matches(data, bench)
    assert {(x.doc_id, x.item_id): (x.n_windows, round(x.share, 9), x.exact) for x in got} == want and len(want) > 100
    assert (550, 50) in want and any(i in range(30, 40) for _, i in want)


def linked_items(docs, bench):
    """The rows of class_matches by document, and the pairs that they and the membership stand for."""
    got = decontaminate.class_matches(docs, bench).collect()
    kin = decontaminate.members(bench).collect()
    every = [(x, m.item_id) for x in got for m in kin if m.class_id == x.class_id and x.variant_id in (None, m.variant_id)]
    assert all(x.n_items == len({i for y, i in every if y is x}) for x in got)
    return got, {(x.doc_id, i) for x, i in every}


def test_classes_and_members_lose_no_link(spark):
    r = random.Random(5)
    text = "the shop of {} sells {} kg of pears and {} kg of plums for {} coins to those who come before the noon bell has rung"

    def fill():
        return text.format(*(r.choice("123") for _ in range(4)))

    bench = [(k, t) for k, t in enumerate(dict.fromkeys(fill() for _ in range(60)))]
    data = [(k, fill() if k % 3 else fill().rsplit(" for ", 1)[0]) for k in range(40)]
    docs, items = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = brute_matches(data, bench)
    got, pairs = linked_items(docs, items)
    assert pairs == set(want) and len(want) > 300
    for x in got:
        mine = {i: want[x.doc_id, i] for d, i in pairs if d == x.doc_id}
        assert (x.n_windows, round(x.share, 9), x.exact) == mine[x.item_id]
    assert {x.doc_id for x in got if x.exact} == {d for (d, _), v in want.items() if v[2]}


def test_one_template_gives_rows_in_proportion(spark):
    text = "a train leaves the town of the north at {} with {} people and reaches the town of the south long before the evening"
    bench = spark.createDataFrame([(k, text.format(1000 + k, 5000 + k)) for k in range(150)], "item_id long, text string")
    docs = spark.createDataFrame([(k, text.format(1075 + k, 5075 + k)) for k in range(150)], "doc_id long, text string")
    got = decontaminate.class_matches(docs, bench).collect()
    assert len(got) == 150 and all(x.n_items == 150 and x.class_id == 0 and x.variant_id is None for x in got)
    assert {(x.doc_id, x.item_id) for x in got if x.exact} == {(k, k + 75) for k in range(75)}
    twice = spark.createDataFrame([(1, text.format(1, 2)), (1, text.format(1, 2)), (1, "other words that stand under the same id as the ones above")], "item_id long, text string")
    assert {x.item_id for x in decontaminate.class_matches(docs.limit(3), twice).collect()} == {1}


def test_both_join_paths_agree(spark, monkeypatch):
    broadcast = queries.op7_decontaminate(spark, SF).toPandas()
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", -1)
    assert rows(queries.op7_decontaminate(spark, SF).toPandas()) == rows(broadcast) and len(broadcast)


# 8 line dedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s))
        s[k : k + 1] = r.choice([[], [r.choice("abc")], [s[k], r.choice("abc")]])
    return "".join(s)


def test_edit_distance():
    r = random.Random(8)
    a = ["".join(r.choice("abc") for _ in range(r.randrange(20, 70))) for _ in range(500)]
    b = [mutated(r, x, r.randrange(6)) for x in a]
    got = line_dedup.distances([x.encode() for x in a], [x.encode() for x in b])
    assert got.tolist() == [min(3, edit(x, y)) for x, y in zip(a, b, strict=True)]


def brute_lines(corpus):
    lines = [(i, k, x.strip(SPACE).encode()) for i, t in corpus for k, x in enumerate((t or "").split("\n")) if x.strip(SPACE)]
    distinct = sorted({x for _, _, x in lines})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            n = min(len(a), len(b))
            most = (n >= 20) + (n >= 40)
            if most and abs(len(a) - len(b)) <= most and edit(a, b) <= most:
                root[find(a)] = find(b)
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(find(x), (i, k))
    return {(i, k) for i, k, x in lines if first[find(x)] != (i, k)}


def test_line_dedup(spark, empty, monkeypatch):
    r = random.Random(9)
    base = ["".join(r.choice("abc ") for _ in range(r.randrange(15, 60))) for _ in range(12)]
    data = [(i, "\n".join(mutated(r, r.choice(base), r.randrange(4)) if r.random() < 0.7 else r.choice(base) for _ in range(r.randrange(1, 4)))) for i in range(40)]
    data += [(100, None), (101, ""), (102, "  \n\t"), (103, base[0] + "\n" + base[0])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    gone = brute_lines(data)
    for hot in (line_dedup.HOT, 2):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "FEW", hot // 32)
        got = {x.doc_id: x for x in line_dedup.dedup(clashing(df, "n_lines", "line", "places", "id", "gone_id", "gone_places")).collect()}
        for i, t in data:
            parts = (t or "").split("\n")
            assert got[i].n_removed == sum((i, k) in gone for k in range(len(parts)))
            kept = "\n".join(p for k, p in enumerate(parts) if (i, k) not in gone)
            assert (got[i].text or "") == (kept if kept.strip(SPACE) or not got[i].n_removed else "")
    assert len(gone) > 10 and got[100].text is None
    twice = line_dedup.dedup(df.union(df)).groupBy("doc_id").agg(F.min("n_removed").alias("a"), F.max("n_removed").alias("b"), F.count("*").alias("n")).collect()
    assert all(x.a == x.b == got[x.doc_id].n_removed and x.n == 2 for x in twice)
    assert line_dedup.dedup(empty).count() == 0


def test_likely_rows_are_all_that_are_wanted_and_few_others(spark):
    rows_ = spark.range(20_000).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("x").alias("word"))
    wanted = rows_.filter("substring(id, 2) < 200").select(F.col("id").alias("at"))
    got = common.likely(rows_, "id", wanted, "at")
    assert got.columns == ["id", "word"] and got.count() < wanted.count() + 200
    assert wanted.join(got, F.col("id") == F.col("at"), "left_anti").count() == 0


def test_texts_are_moved_once_for_all_turns(spark, monkeypatch):
    moved, verified = [], []
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "FEW", 0)
    monkeypatch.setattr(graph, "FEW", 0)
    fetched, connected = line_dedup.Join.fetched, graph.connected
    monkeypatch.setattr(line_dedup.Join, "fetched", lambda self, names: moved.append(1) or fetched(self, names))
    monkeypatch.setattr(line_dedup, "connected", lambda e, m, a, verify: connected(e, m, a, lambda p: verified.append(1) or verify(p)))
    data = [(k, f"number {k:05d} of a family of lines that differ in one or two figures") for k in range(300)]
    got = line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string")).agg(F.sum("n_removed")).first()
    assert got[0] == 299 and len(moved) == 1 and len(verified) > 1


def test_rounds_on_few_edges_shuffle_nothing(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 200)], "a long, b long")
    for each in (graph.EACH, 50):
        monkeypatch.setattr(graph, "EACH", each)
        assert ("hashpartitioning" in graph._dealt(graph._small_star(graph._large_star(edges, 199), 199), 199)._jdf.queryExecution().executedPlan().toString()) == (each == 50)
        assert {(x.node, x.component) for x in components(edges).collect()} == {(k, 0) for k in range(200)}


def test_lines_of_equal_polynomials_stay(spark):
    """The Thue-Morse order and its opposite, which polynomials modulo a power of two take for equal."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    one = "".join("ab"[b] for b in bits)
    two = "".join("ba"[b] for b in bits)
    assert [x.n_removed for x in line_dedup.dedup(spark.createDataFrame([(0, one), (1, two)], "doc_id long, text string")).collect()] == [0, 0]


def test_many_lines_of_one_segment_and_very_long_lines(spark):
    r = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    many = ["the same first third of each line" + "".join(r.choice(letters) for _ in range(66)) for _ in range(20_000)]
    near = [x[:50] + "#" + x[51:] for x in many[:300]] + [x[:60] + x[61:] for x in many[300:500]]
    family = [f"number {k:05d} of a family of lines that differ in one or two figures" for k in range(600)]
    huge = "".join(r.choice(letters) for _ in range(300_000))
    data = [(k, "\n".join(many[k * 200 : (k + 1) * 200])) for k in range(100)]
    data += [(200, "\n".join(near)), (300, "\n".join(family)), (400, huge), (401, huge[:100_000] + huge[100_001:140_000] + "#" + huge[140_000:]), (402, huge[::-1]), (403, huge[1:] + "###")]
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(16)).collect()}
    assert [got[k] for k in range(100)] == [0] * 100 and got[200] == 500 and got[300] == 599
    assert [got[k] for k in (400, 401, 402, 403)] == [0, 1, 0, 0]


def test_keys_without_an_index_entry_end_in_their_task():
    import numpy as np
    import pyarrow as pa

    def entries(key, lines, bags, index):
        line = np.asarray(lines, np.uint64) >> np.uint64(1) | np.asarray(index, np.uint64) << line_dedup.INDEX
        order = np.argsort(line.view(np.int64), kind="stable")
        columns = np.full(len(line), key), line[order].view(np.int64), np.asarray(bags, np.int64)[order]
        return pa.record_batch(list(map(pa.array, columns)), names=["key", "line", "bag"])

    def made(*batches):
        return [x for b in line_dedup._to_pairs(iter(batches)) for x in b.to_pylist()]

    lines, far = np.arange(2, 20_002, 2), np.arange(10_000) * 0x123457
    for at in (3000, 7000, 10_000):  # probes alone, in one batch or more
        probes = entries(1, lines, far, np.zeros(10_000))
        assert made(probes.slice(0, at), probes.slice(at), entries(2, [2, 4], [0, 0], [0, 0])) == []
    assert [(x["key"], x["a"], x["b"]) for x in made(entries(1, lines, far, np.zeros(10_000)), entries(2, [2, 4], [0, 0], [1, 0]))] == [(None, 2, 4)]
    # many lines under one key: the few near ones leave the task as pairs
    r = np.random.default_rng(3)
    bags = r.integers(0, 1 << 62, 600)
    bags[10] = bags[500] ^ 1
    assert [(x["key"], x["a"], x["b"]) for x in made(entries(1, lines[:600], bags, np.ones(600)))] == [(None, int(lines[10]), int(lines[500]))]
    # as entries if they are too many for a task or all alike, each once
    many = made(entries(1, lines, far, np.arange(10_000) == 5))
    assert len(many) == 10_000 and all(x["key"] == 1 and x["b"] is None for x in many)
    alike = made(entries(1, lines, np.zeros(10_000), np.arange(10_000) == 5))
    assert len(alike) == 10_000 and all(x["key"] == 1 and x["b"] == 1 for x in alike)


# 10 suffix tree


def test_suffix_tree(spark, docs, corpus, empty):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {x.doc_id: x for x in suffix_tree.train_and_score(spark, clashing(docs, "score", "h"), train).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for i, t in corpus}
    count = Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(count[y] > 0 for y in w), n) and abs(x.base_score - base) < 1e-6
        assert x.score < 0
    assert suffix_tree.train_and_score(spark, empty, F.lit(True)).count() == 0
    lonely = suffix_tree.train_and_score(spark, docs, F.lit(False)).collect()
    assert all(x.n_known == 0 and abs(x.score - x.base_score) < 1e-9 for x in lonely)


class BruteTree:
    """The tree of lists of tokens, by its definition."""

    def __init__(self, texts, depth):
        self.count = [Counter() for _ in range(depth + 2)]
        for w in texts:
            for k in range(1, depth + 2):
                for i in range(len(w) - k + 1):
                    self.count[k][tuple(w[i : i + k])] += 1
        self.total, self.kinds, self.rest, self.depth = sum(self.count[1].values()), len(self.count[1]), {}, depth
        for k in range(1, depth + 1):
            following = defaultdict(dict)
            for g, n in self.count[k + 1].items():
                if n >= suffix_tree.LEAST_EDGE:
                    following[g[:-1]][g[-1]] = n
            fresh = {}
            for c, edges in following.items():
                n = self.count[k][c]
                if n < suffix_tree.LEAST_CONTEXT:
                    continue
                rest = 1 - sum((m - suffix_tree.DISCOUNT) / n for m in edges.values())
                gain = sum(m * np.log(((m - suffix_tree.DISCOUNT) / n + rest * (q := self.p(c[1:], s))) / q) for s, m in edges.items())
                gain += (n - sum(edges.values())) * np.log(rest)
                if gain >= suffix_tree.LEAST_GAIN:
                    fresh[c] = rest
            self.rest |= fresh

    def p(self, past, s):
        if not past:
            return (self.count[1][s,] + 0.5) / (self.total + 0.5 * (self.kinds + 1))
        low = self.p(past[1:], s)
        if past not in self.rest:
            return low
        n = self.count[len(past) + 1][(*past, s)]
        return (max(0, (n - suffix_tree.DISCOUNT) / self.count[len(past)][past]) if n >= suffix_tree.LEAST_EDGE else 0) + self.rest[past] * low


@pytest.mark.parametrize("most", [1 << 19, 40, 0])
def test_suffix_tree_scores_by_the_longest_state(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_tree, "MOST_WORDS", most)
    monkeypatch.setattr(suffix_tree, "MOST_ENTRIES", most)
    r = random.Random(14)
    phrases = [[r.choice(WORDS[:9]) for _ in range(r.randrange(4, 8))] for _ in range(14)]
    data = [(i, " ".join(" ".join(r.choice(phrases)) if r.random() < 0.7 else r.choice(WORDS) for _ in range(r.randrange(1, 30)))) for i in range(150)]
    data += [(200, None), (201, ""), (202, "Never Seen before"), (203, " ".join(phrases[0] * 500)), (None, " ".join(phrases[1])), (3, data[3][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    got = suffix_tree.train_and_score(spark, clashing(df, "row", "rare", "known", "far", "body", "at", "_row", "_rare", "base"), ~held).collect()
    tokens = [(i, (t or "").lower().split() + [None]) for i, t in data]
    tree = BruteTree([w for i, w in tokens if i is None or i % 5 != 1], suffix_tree.DEPTH)
    assert {len(c) for c in tree.rest} == {1, 2, 3, 4} and suffix_tree.DEPTH == 4
    want = sorted((str(i), round(sum(np.log10(tree.p(tuple(w[max(0, k - 4) : k]), s)) for k, s in enumerate(w)), 6)) for i, w in tokens)
    assert [(str(x.doc_id), round(x.score, 6)) for x in sorted(got, key=lambda x: (str(x.doc_id), round(x.score, 6)))] == want
    seen = {s for i, w in tokens if i is None or i % 5 != 1 for s in w}
    for x in got:
        w = next(w for i, w in tokens if i == x.doc_id)
        assert x.n_known == sum(s in seen for s in w) and x.row == x._rare == "x"
    # over all symbols and an unseen one, probabilities add up to one after any past
    for past in list(tree.rest)[:50]:
        assert abs(sum(tree.p(past, s) for s in seen) + tree.p(past, "unseen") - 1) < 1e-9


def test_suffix_tree_deals_hot_contexts_and_moves_few_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MOST_ENTRIES", 8 * 64)
    texts = spark.createDataFrame([(" ".join(["a b c d", f"a b x{i % 5}"][i % 3 > 0] for i in range(j, j + 40)),) for j in range(60)], "text string")
    tree = suffix_tree.fit(texts, common.checkpointed(suffix_tree.word_counts(texts)))
    assert tree.parts.cold > 1 and all(len(keys) for keys, _, _ in tree.parts.hot[:2]) and tree.parts.n > tree.parts.cold
    # rows are by part and hot context, not by entry
    assert tree.entries.count() <= tree.parts.n + len(tree.parts.pairs)


def test_suffix_tree_sums_are_packed():
    number, sums = np.array([0, 3, 70000]), np.array([-1234.5678, 1e-9, 9.75])
    back = suffix_tree._unpacked_sums(suffix_tree._packed_sums(number, sums))
    assert back[0].tolist() == number.tolist() and np.abs(back[1] - sums).max() < 1e-12


# registration and pipeline


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_language_id", "op3_quality_model", "op9_toxicity"])
def test_held_out_quality(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert got["score"].between(0, 1).all()
    if name == "op1_language_id":
        m = got.merge(duck.execute("SELECT doc_id, lang FROM documents").df(), on="doc_id")
        held = m[m.held_out]
        assert (held.lang == held.lang_pred).mean() > 0.97
        return
    column, least = {"op3_quality_model": ("quality", 0.97), "op9_toxicity": ("toxic", 0.9)}[name]
    m = got.merge(duck.execute("SELECT * FROM labels").df(), on="doc_id")
    held = m[m.held_out]
    assert (held[column] == held.predicted).mean() > least


def test_pipeline_against_brute_force(spark, duck):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    step = kept.toPandas()
    lined = C.drop_repeated_lines(spark, kept, SF)
    data = list(zip(step.doc_id, step.text, strict=True))
    exact = defaultdict(list)
    for i, t in sorted(data):
        for k, x in enumerate(t.split("\n")):
            if x.strip(SPACE):
                exact[x.strip(SPACE)].append((i, k))
    got = {x.doc_id: x for x in lined.collect()}
    first = {v[0] for v in exact.values()}
    for i, t in data:
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) in first]
        mine = [x for x in got[i].text.split("\n") if x.strip(SPACE)] if i in got else []
        assert set(mine) <= set(left) and len(left) - len(mine) <= 3  # near lines may go too
        assert i not in got or got[i].n_chars == (len(got[i].text) if len(got[i].text) < len(t) else step.set_index("doc_id").n_chars[i])
    single = C.drop_near_copies(spark, lined, SF)
    classes = brute_classes(brute_simhash([(i, x.text) for i, x in got.items()], C.SHINGLE))
    assert sorted(x.doc_id for x in single.collect()) == sorted(set(classes.values()))
    clean = C.drop_benchmark(spark, single, SF)
    found = {x.doc_id for x in decontaminate.matches(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {x.doc_id for x in clean.collect()} == {x.doc_id for x in single.collect()} - found
    end = C.run(spark, SF).collect()
    texts = {x.doc_id: x.text for x in clean.collect()}
    assert {x.doc_id: x.decoded_sha256 for x in end} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}


def test_readings_do_not_depend_on_where_agreement_is_put_out(monkeypatch):
    r = random.Random(8)
    chars = toxicity.CharModel({f"{a}{b}{c}": r.randrange(1, 40) for a in "^abcils" for b in "abcils" for c in "abcils$"})
    spans = ["".join(r.choice("abcils0135$!-. *") for _ in range(n)) for n in (24,) * 120 + (300,) * 5]
    whole = [chars._viterbi(x) for x in spans]
    for window in (1, 8, 50):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        for x, (score, text) in zip(spans, whole, strict=True):
            got = chars._viterbi(x)
            assert got[1] == text and abs(got[0] - score) < 1e-9


def test_labels_without_a_text_take_no_place(spark):
    from driftloom.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(7, "text 7"), (8, "another"), (None, "x"), (9000, None)], "doc_id long, text string")
    labels = spark.range(40_500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).union(spark.createDataFrame([(7, None), (8, 1), (None, 1)], "doc_id long, toxic int"))
    got = labelled_sample(docs, labels, "doc_id", "text", "toxic", 4000, "s").collect()
    assert len(got) == 502 and len({x.h for x in got}) == 502  # with the second text of 8 and the null one of 9000
    assert {x.label for x in got if x.text in ("text 8", "another")} == {1} and "" in {x.text for x in got}
    few = labelled_sample(docs, labels, "doc_id", "text", "toxic", 60, "s").collect()
    assert len(few) == 60 and {x.h for x in few} <= {x.h for x in got}
    assert labelled_sample(docs.limit(0), labels, "doc_id", "text", "toxic", 60, "s").count() == 0


def test_columns_named_like_the_output_in_another_case(spark):
    df = spark.createDataFrame([(1, "some words here. " * 5, "en"), (2, None, "en")], "doc_id long, text string, lang string")
    made = {"Score": "score", "PREDICTED": "predicted", "Lang_Pred": "lang_pred", "N_Words": "n_words", "Kept": "kept", "N_Lines": "n_lines", "N_Tokens": "n_tokens", "N_Bytes": "n_bytes"}
    other = clashing(df, *made)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for found, own in (
        (language_id.identify(other, language_id.fit(df)), {"lang_pred", "score"}),
        (quality_model.score(other, quality_model.fit(df, labels)), {"score", "predicted"}),
        (toxicity.score(other, toxicity.fit(df, labels)), {"score", "predicted"}),
        (rules.quality_rules(other), {"n_words", "kept", "n_lines"}),
        (suffix_dedup.dedup(other), {"n_bytes", "kept"}),
        (line_dedup.dedup(other), {"n_lines"}),
        (suffix_tree.train_and_score(spark, other, F.lit(True)), {"n_tokens", "score"}),
    ):
        lower = [c.lower() for c in found.columns]
        assert len(set(lower)) == len(lower) and own <= set(found.columns)
        assert {c for c in made if made[c] not in own} <= set(found.columns) and found.count() == 2


def test_pipeline_stages_keep_the_columns_of_the_caller(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, "all clear words in a line\nand another line here\n" + f"number {i * 1111} of many", 7.5, "p", 3, "k") for i in range(6)] + [(None, None, 1.0, None, None, None), (3, "", 2.0, "q", 1, "k"), (4, "all clear words in a line", 7.5, "p", 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double, predicted string, n_lines int, N_Removed string")
    spark.createDataFrame([(i, i % 2, int(i == 99)) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {(x.Score, x.predicted, x.n_lines, x.N_Removed) for x in kept.collect()} <= {x[2:] for x in rows}
    assert [x.text for x in kept.filter("doc_id = 5").collect()] == ["number 5555 of many"]
