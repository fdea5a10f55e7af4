"""Phrase mining, spelling variants and nearest neighbours against brute force and SQL, and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwatt.llm import collocations, nearest, spelling
from spanwatt.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("n", "word", "words", "phrase", "a", "l", "r", "score", "rank", "heap", "h", "form", "root", "near", "vec", "id", "leaf", "tree", "key", "query_id")


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", None) for k, t in enumerate(texts)], SCHEMA)


def with_clashes(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_spelling_variants"])
def test_sql(spark, name):
    """The registered SQL on the smallest table."""
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ------------------------------------------------------------------ phrases


def mined(docs, least, first, share=(100, 100)):
    """Brute force over (text, lang)."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        held = defaultdict(int)
        for p, n in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], n)
        rows = []
        for p, a in found.items():
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if share[0] * held[p] < share[1] * a or not held[p]:
                rows.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), a, left, right, total[lang], -s) for n, (s, _, p, a, left, right) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["to", "be", "or", "not", "Ärger", "été", "a b", "x-1", "😀", "THE"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", " \x1c ", "?!"]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("first", "share"), [(2000, (100, 100)), (7, (100, 80))])
def test_phrases(spark, first, share):
    rows = [(t, rng) for k, t in enumerate(random_texts(1, 120)) for rng in [[None, "en", "de"][k % 3]]] + [("to be or not to be", "en")] * 40
    df = spark.createDataFrame([(k, t, lang, None, None) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted(map(tuple, collocations.mine(df, 15, first, share).collect()))
    assert got == mined(rows, 15, first, share) and len({r[0] for r in got}) == 3


def test_phrases_at_the_threshold(spark):
    """Just as often as asked, one less, and repeats that overlap; counts meet from many tasks."""
    rows = [("up up up", "en")] * 5 + [("left right", "en")] * 10 + [("left wrong", "en")] * 9
    df = spark.createDataFrame([(k, t, lang, None, None) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(12)
    got = {r.phrase: (r.a, r.l, r.r) for r in collocations.mine(df, 10).collect()}
    assert got == {"up up": (10, 15, 15), "left right": (10, 19, 10)}


def test_phrases_odd(spark):
    """Nulls, empty texts, repeated rows, no row, and columns of clashing names; one text longer than a run."""
    long = "one two three. " * 500_000
    df = with_clashes(docs_of(spark, [None, "", " \t.\n", "one", long, "one two three"], None)).unionByName(with_clashes(docs_of(spark, ["one two three"], None)))
    got = {r.phrase: (r.lang, r.a, r.n) for r in collocations.mine(df).collect()}
    assert got == {"one two three": ("und", 500_002, 1_500_007)}
    assert collocations.mine(docs_of(spark, ["a"]).limit(0)).count() == 0 and collocations.mine(docs_of(spark, [None])).count() == 0


def test_misra_gries():
    """No key of the threshold is lost, whatever the capacity; with a capacity above mass / threshold the counters stay few."""
    rng = np.random.default_rng(3)
    keys = np.concatenate([np.repeat(np.arange(50, dtype=np.uint64), 120), rng.integers(1000, 2**62, 30_000, dtype=np.uint64), rng.integers(10**6, 10**6 + 3000, 20_000, dtype=np.uint64)])
    rng.shuffle(keys)
    true = {k for k, n in Counter(keys.tolist()).items() if n >= 100}
    for capacity in (1, 30, 700, 10**6):
        kept = collocations.MisraGries(100, capacity)
        for part in np.array_split(keys, 40):
            kept.merge(*np.unique(part, return_counts=True))
            kept.settle()
        assert true <= set(kept.frequent().tolist()) and kept.lost < 100
        if capacity == 700:  # 56,000 / 100 and more
            assert len(kept.keys) <= 700
    assert len(collocations.MisraGries(5, 10).frequent()) == 0


# ------------------------------------------------------------------ spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def varied(counts):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        out[w] = [best if best and counts[best] >= 2 * n else None, n, len(around)]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x.insert(1, root)
    return {(w, f, root, n, k, counts.get(f)) for w, (f, root, n, k) in out.items()}


def test_variants(spark):
    """Dense words over few letters: every kind of edit at every place, chains of forms, ties."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(700)} | {"a" * k for k in range(5, 12)} | {"abcde" * 30, "abcde" * 29 + "abce", "xbcde" * 30}
    counts = {w: rng.choice([3, 3, 4, 6, 8, 16, 64, 200]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == varied(counts) and max(r[4] for r in got) > 5 and any(r[1] and r[1] != r[2] for r in got)


def test_walk_in_small_steps(spark, monkeypatch):
    """Groups are cut and steps halved without a change."""
    words = sorted({"ab" + "".join(random.Random(k).choices("ab", k=5)) for k in range(60)})
    grid = np.array([w.encode() for w in words], "S7").view(np.uint8).reshape(len(words), 7)
    args = (grid, np.full(len(words), 7), np.zeros(len(words), np.int64), 2, 7)
    whole = set(zip(*(x.tolist() for x in spelling._walk(*args)), strict=True))
    monkeypatch.setattr(spelling, "STEPS", 5)
    assert whole == set(zip(*(x.tolist() for x in spelling._walk(*args)), strict=True)) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


def counted(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_vocabulary(spark):
    """Letters next to digits, marks and other scripts, long runs, ids of any kind; repeated rows count again."""
    rng = random.Random(4)
    words = ["Straße", "ÉTÉÉÉ", "naïveté", "plain", "words", "x" * 300, "éàü" * 60, "über×÷", "日本plain", "plain1plain", "İplain", "ab", "Ünits"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(200)] + [(None, "plain words"), (7, None), (8, ""), (-5, "plain " * 500)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows + rows[:9]], SCHEMA)
    assert {r.word: r.n for r in spelling.vocabulary(with_clashes(df)).collect()} == counted(rows + rows[:9])
    texts = spark.createDataFrame([(f"id-{k}", t) for k, t in rows], "doc_id string, text string")
    assert {r.word: r.n for r in spelling.vocabulary(texts).collect()} == counted([(f"id-{k}", t) for k, t in rows])
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 400_000)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.vocabulary(long).collect()} == counted([(1, "lorem ipsum dolor " * 400_000)])
    none = spelling.variants(spelling.vocabulary(docs_of(spark, ["a"]).limit(0)))
    assert none.count() == 0 and spelling.variants(spelling.vocabulary(docs_of(spark, [None, "abcde abcde abcde"]))).count() == 1


# ------------------------------------------------------------------ neighbours


def closest(rows, asked, k):
    """Brute force: ids with all their vectors."""
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == len(asked[0][1]) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in asked}:
        gaps = defaultdict(lambda: math.inf)
        for own in [v for i, v in sound if i == q]:
            for i, v in sound:
                if i != q:
                    gaps[i] = min(gaps[i], float(np.sqrt(((v - own) ** 2).sum())))
        out[q] = sorted((d, i) for i, d in gaps.items())[:k]
    return {q: x for q, x in out.items() if x}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return dict(out)


def test_small_neighbours(spark):
    """One leaf is exact: ties, equal vectors, shared ids, and vectors that take no part."""
    rng = np.random.default_rng(5)
    rows = [(int(k), rng.integers(-3, 4, 3).astype(float).tolist()) for k in range(120)] + [(200 + k, [1.0, 2.0, 3.0]) for k in range(30)]
    rows += [(500, None), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 2.0]), (800, [1.0, float("nan"), 2.0]), (900, [float("inf"), 1.0, 1.0]), (1000, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (100, [2.0, -0.0, 2.0]), rows[3], rows[3]]
    df = with_clashes(vectors(spark, rows))
    asked = df.where("vec_id % 10 = 0")
    got = found(nearest.nearest(df, asked))
    want = closest(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0 and r[1] and len(r[1]) == 3], 10)
    assert got == want and 600 not in got and 1000 not in got
    few = vectors(spark, rows[:4])
    assert {q: len(x) for q, x in found(nearest.nearest(few, few)).items()} == {q: 3 for q in range(4) if any(rows[q][1])}
    assert nearest.nearest(few.limit(0), few.limit(0)).count() == 0 and nearest.nearest(few, few.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "independent"])
def test_recall(spark, kind, monkeypatch):
    """Many leaves and blocks: recall of 0.9 at least, scores exact; near neighbours in clusters cost a part of the table."""
    monkeypatch.setattr(nearest, "BLOCK", 40)
    rng = np.random.default_rng(6)
    data = rng.normal(size=(3000, 16))
    if kind == "clusters":
        data = 8 * rng.normal(size=(60, 16))[rng.integers(0, 60, 3000)] + 0.5 * data
    data[500:1500] = data[500]  # a third is one vector
    df = vectors(spark, [(k, v.tolist()) for k, v in enumerate(data)]).repartition(6)
    got = found(nearest.nearest(df, df.where("vec_id % 20 = 0"), leaf=50, sample=2000))
    hits = total = 0
    for q in range(0, 3000, 20):
        gap = np.sqrt(((data - data[q]) ** 2).sum(1))
        gap[q] = np.inf
        order = np.lexsort((np.arange(3000), gap))[:10]
        assert all(d == gap[i] for d, i in got[q]) and got[q] == sorted(got[q])
        hits, total = hits + len({i for _, i in got[q]} & set(order.tolist())), total + 10
    assert hits / total >= 0.9


def test_share():
    """Clusters need a small part of the forest, independent coordinates most of it."""
    rng = np.random.default_rng(7)
    spread = rng.normal(size=(2000, 32))
    tight = 10 * rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + 0.3 * spread
    assert nearest.Forest(tight, 4, 5).share(tight, 0.95, 10) < 0.3 < nearest.Forest(spread, 4, 5).share(spread, 0.95, 10)
