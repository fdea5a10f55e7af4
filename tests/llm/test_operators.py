"""Small cases and brute-force versions."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanwatt.llm import bpe, common, decontamination, jaccard_join, kd_sharding, language_id, line_dedup, quality_rules, substring_dedup, suffix_dedup, token_files
from spanwatt.llm.queries import QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], SCHEMA)


def base(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [None, "", " \t\n ", "one", "x" * 5000, "a " * 3000, "é€😀 " * 40, "same text here\nsame text here", "same text here\nsame text here", "퟿\u0000 nul"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with clashing names."""
    rows = make(spark, ODD)
    rows = rows.union(rows.where("doc_id = 8")).union(spark.createDataFrame([(None, "same text here\nsame text here", None, None, None)], SCHEMA))
    for name in ("key", "id", "n_words", "kept", "ids", "score", "kept_text", "node", "root", "n_lines", "h", "_h", "decoded", "size", "row"):
        rows = rows.withColumn(name, F.lit(1))
    return rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert language_id.identify(none, model).count() == 0
    langs, table = language_id.fit(none)
    assert langs == [] and {r.lang_pred for r in language_id.identify(odd, (langs, table)).collect()} == {"und"}


def tiktoken_encoding():
    import base64

    import tiktoken

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, none):
    path, codec = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", tiktoken_encoding()
    rng = random.Random(3)
    texts = [*ODD, "a" * 4001, "ab" * 700 + "a" * 77, "".join(rng.choice("ab") for _ in range(2000)), "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(2000)), "<|endoftext|> it's we'll  \n x"]
    made = bpe.decode(bpe.encode(make(spark, texts), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    for r in made:
        assert r.ids == codec.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(odd, path, public_tokenizers.PATTERN).count() == 12
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, SF).collect():
        ids = codec.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_sharding(spark, odd, none):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op3_kd_sharding"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    weight = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert max(weight) - min(weight) <= max(r["size"] for r in rows)
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert kd_sharding.kd_shards(odd, 5).count() == 12
    assert kd_sharding.kd_shards(none, 8).count() == 0
    same = kd_sharding.kd_shards(make(spark, ["copy"] * 64), 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in same) == [8] * 8


def words(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_substrings(spark, odd, none):
    rng = random.Random(1)
    shared = base(rng, 55)
    texts = [base(rng, 30) + " " + shared + " " + base(rng, 9), shared, base(rng, rng.randint(1, 20)) + "\n" + shared, base(rng, 200), None, "", shared + " " + shared, *[shared + " " + base(rng, 70)] * 3]
    got = {r.doc_id: r for r in substring_dedup.dedup(make(spark, texts)).collect()}
    seen: dict = {}
    for k, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), k)
    for k, t in enumerate(texts):
        w = words(t)
        gone = {p for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        assert got[k].n_removed == len(gone) and got[k].kept_text == " ".join(x for p, x in enumerate(w) if p not in gone)
    assert substring_dedup.dedup(odd).count() == 12
    assert substring_dedup.dedup(none).count() == 0


def test_suffixes(spark, odd, none):
    rng = random.Random(2)
    shared = base(rng, 60)
    texts = [base(rng, 30) + shared + base(rng, 9), shared[:150] + shared[20:180], "q" * 350, base(rng, 3) + shared[40:], None, "", "q" * 120, *[shared + base(rng, 70)] * 2, shared[:99]]
    got = {r.doc_id: r for r in suffix_dedup.dedup(make(spark, texts)).collect()}
    seen = set()
    for k, t in enumerate(texts):
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        assert got[k].n_removed == len(gone), k
        assert bytes(got[k].kept) == bytes(x for p, x in enumerate(raw) if p not in gone)
    assert suffix_dedup.dedup(odd).count() == 12
    assert suffix_dedup.dedup(none).count() == 0


def test_rules(spark, odd, none):
    rng = random.Random(8)
    good = "\n".join(base(rng, 14) + "." for _ in range(9))
    menu = "\n".join("Home | About | Contact | Help | Login" for _ in range(30))
    got = {r.doc_id: r for r in quality_rules.judged(make(spark, [good, menu + "\n" + good[:100], None, good + "\nHome | About | Contact | Help"])).collect()}
    assert got[0].kept and got[0].n_lines_removed == 0 and got[0].kept_text == good
    assert not got[1].kept and got[1].n_lines_removed == 30
    assert not got[2].kept and got[2].n_words == 0 and got[2].kept_text is None
    assert got[3].kept and got[3].kept_text == good
    assert quality_rules.judged(odd).count() == 12
    assert quality_rules.judged(none).count() == 0


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    item, short = base(rng, 20), "Tiny Item"
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (None, "null id item"), (2, "Tiny Item")], "item_id long, text string")
    texts = [base(rng, 50) + " " + item.upper()[: len(item)] + " " + base(rng, 5), "a tiny,item!", base(rng, 100), None, "null id item"]
    got = {r.doc_id: r for r in decontamination.mark(make(spark, texts), bench).collect()}
    assert got[0].hit_words == list(range(50, 70)) and got[0].hit_items == [1]
    assert got[1].hit_words == [1, 2] and got[1].hit_items == [2]
    assert got[2].hit_words == [] and got[3].n_words == 0 and got[4].hit_words == [0, 1, 2] and got[4].hit_items == []
    many = {r.doc_id: (r.hit_words, r.hit_items) for r in decontamination.mark(make(spark, texts), bench, block_bytes=30).collect()}
    assert many == {k: (r.hit_words, r.hit_items) for k, r in got.items()}
    assert decontamination.mark(odd, bench).count() == 12 and decontamination.mark(none, bench).count() == 0
    assert decontamination.mark(odd, bench.limit(0)).where("size(hit_words) > 0").count() == 0


def test_lines(spark, odd, none):
    rng = random.Random(5)
    line, other = base(rng, 60), base(rng, 60)
    near = line[:-1] + "z"
    texts = [f"{line}\n{other}", f"{base(rng, 9)}\n{line.upper()}!", near + "\n12 apples", "13 apples\n***", None, "***\n***", ""]
    got = {r.doc_id: r for r in line_dedup.dedup(make(spark, texts)).collect()}
    assert got[0].n_lines_removed == 0 and got[1].n_lines_removed == 1 and got[1].kept_text == texts[1].split("\n")[0]
    assert got[3].kept_text == "***" and got[4].kept_text is None and got[5].kept_text == "***\n***" and got[6].kept_text == ""
    assert line_dedup.dedup(odd).count() == 12 and line_dedup.dedup(none).count() == 0


def test_line_links(spark):
    """Connected groups of the links equal those of all pairs near in SimHash and edit distance."""
    rng = random.Random(6)
    lines = []
    for _ in range(12):
        line = base(rng, 40)
        lines += [line, *(line[:p] + "x" + line[p + 1 :] for p in rng.sample(range(len(line)), 6))]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(sorted(set(lines)))], "id long, face string").withColumn("h", F.xxhash64("face"))
    sims = {r.h: r.sim for r in line_dedup.simhashes(rows).collect()}
    text = {r.h: r.face for r in rows.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def groups(pairs):
        root = {h: h for h in text}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {h: find(h) for h in text}

    want = [(a, b) for a in text for b in text if a < b and ((sims[a] ^ sims[b]) & (2**64 - 1)).bit_count() <= 12 and distance(text[a], text[b]) <= 0.2 * max(len(text[a]), len(text[b])) + 1e-9]
    found = [tuple(r) for r in line_dedup.links(rows).collect()]
    assert want and set(found) <= set(want) and groups(found) == groups(want)


def test_line_numbers(spark):
    """Lines that differ in much of their digits both stay; typography doesn't tell lines apart."""
    pairs = [("2021 42.1 kg", "7 kg"), ("2021 kg", "7315 kg"), ("4711", "9035"), ("a\u2013b \u201cc\u201d d\u00a0e", 'A-b "c" d e'), ("90210 31337", "90210 31337"), ("12,50 \u20ac", "99,99 \u20ac")]
    got = {r.doc_id: r for r in line_dedup.dedup(make(spark, [f"{a}\n{b}" for a, b in pairs])).collect()}
    assert [got[k].n_lines_removed for k in range(len(pairs))] == [0, 0, 0, 1, 1, 0]


def test_line_recall(spark):
    """Against all pairs of enough edit similarity, whatever their SimHashes."""
    rng = random.Random(9)
    lines = set()
    for n in [10] * 40 + [20] * 15:
        w = base(rng, n).split(" ")
        k = rng.randrange(n)
        lines |= {" ".join(w), " ".join([*w[:k], base(rng, 1), *w[k + 1 :]])}
    for _ in range(15):  # no spaces
        w = [chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(30)]
        lines |= {"".join(w), "".join([*w[:11], "\u4e00\u4e01", *w[13:]])}
    rows = spark.createDataFrame([(x,) for x in sorted(lines)], "face string").withColumn("h", F.xxhash64("face"))
    a, b = (rows.select(F.col("face").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * 0.2 + 1e-9).cast("int")
    want = {(r.ha, r.hb) for r in a.join(b, F.col("ha") < F.col("hb")).where(F.abs(F.length("a") - F.length("b")) <= most).where(F.call_function("levenshtein", F.col("a"), F.col("b"), most) >= 0).collect()}
    found = {(min(r), max(r)) for r in line_dedup.links(rows).collect()}
    assert len(want) > 60 and len(found & want) / len(want) > 0.8 and found <= want


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)]
    root = list(range(401))
    for _ in range(401):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: root[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    whole = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    start = 0
    rows = sorted(QUERIES["op9_token_files"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*whole.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert token_files.token_table(spark, odd, path).count() == 12
    assert token_files.token_table(spark, none, path).count() == 0
    made = token_files.write_tokens(make(spark, ["one two three", None, "x " * 50]), path, 1, sequence=8, parts=1).collect()
    (ids, mask), (last, tail) = token_files.sequences(made[0].path, [0, (made[0].n_tokens - 1) // 8])
    assert ids.tolist() == [*whole.encode("one two three").ids, 1, 1, *whole.encode("x x x").ids] and mask.all()
    assert tail.sum() == (made[0].n_tokens - 1) % 8 + 1 and last[tail][-1] == 1


def test_token_separators(spark):
    """The tokenizer keeps U+001C to U+001F, which str.split() drops."""
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    whole, texts = Tokenizer.from_file(path), ["a\x1fb", "one\x1c two\x1d\x1e", "\x1f", "plain\x85text\u00a0here\u2028x"]
    want = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for r in token_files.token_table(spark, make(spark, texts), path).collect():
        assert (r.start, r.n_tokens) == (sum(map(len, want[: r.doc_id])), len(want[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want[r.doc_id]))


def test_word_encoder():
    """Letters, marks, contractions, control and combining characters, and the tokenizer's own special tokens."""
    from tokenizers import Tokenizer

    path, rng = f"{TOKENIZERS}/word_bpe_49k.json", random.Random(11)
    whole, encode = Tokenizer.from_file(path), token_files.word_encoder(path, token_files.np.uint16)
    pieces = ["a", "B", "zé", "é", "e\u0301", "İ", "ß", "Σ", "中文", "한", "\u1112\u1161", "'s", "'LL", "n't", "don't", ",", "!!", "#'", "<|endoftext|>", "<|", "7", "½", "٣", "😀", "\u0338", "=", "<", " ", "  ", "\n", "\t", "\x00", "\x1c", "\x1f", "\x85", "\u00a0", "\u200b", "\u2028", "\ufeff", "x" * 90]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(4000)] + [chr(c) + "a" + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for t, got in zip(part, encode(part), strict=True):
            assert token_files.np.frombuffer(got, token_files.np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_jaccard(spark, folder):
    docs = [(r.doc_id, shingles(r.text), r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    held: dict = {}
    for k, (_, s, _) in enumerate(docs):
        for x in s:
            held.setdefault(x, []).append(k)
    common_: dict = {}
    for ks in held.values():
        for a in ks:
            for b in ks:
                if a < b:
                    common_[a, b] = common_.get((a, b), 0) + 1
    root, n = list(range(len(docs))), [0] * len(docs)
    pairs = [p for p, c in common_.items() if 1.8 * c >= 0.8 * (len(docs[p[0]][1]) + len(docs[p[1]][1])) - 1e-6]
    for a, b in pairs:
        n[a], n[b] = n[a] + 1, n[b] + 1
    for _ in range(30):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r for r in QUERIES["op10_jaccard_join"](spark, folder).collect()}
    assert len(got) == len(docs)
    for k, (i, _, _) in enumerate(docs):
        assert got[i].n_links == n[k] and got[i].group_id == docs[root[k]][0], i


def test_jaccard_odd(spark, odd, none):
    got = jaccard_join.join(odd).collect()
    assert len(got) == 12 and jaccard_join.join(none).count() == 0
    copies = [r for r in got if r.doc_id in (7, 8, None)]
    assert {(r.class_id, r.group_id, r.n_links) for r in copies} == {(7, 7, 3)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.written(stage(spark, now, SF))
        if name != "byte_bpe":
            assert now.columns == docs.columns
        if name == "jaccard_join":
            made = jaccard_join.join(before)
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in made.where("doc_id = group_id").collect()}
    codec, texts = tiktoken_encoding(), {r.doc_id: r.text for r in before.collect()}
    for r in now.collect():
        assert r.ids == codec.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_languages(spark):
    """Gibberish and languages without a label go, labelled ones stay."""
    import corpus_pipeline

    rng = random.Random(10)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (60, 100, 300, 1000, 5000)]
    junk += ["Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства", "いろはにほへと散りぬるを我が世誰ぞ常ならむ有為の奥山今日越えて浅き夢見じ酔ひもせず", "Zażółć gęślą jaźń, a potem wszyscy poszliśmy do domu, bo było już bardzo późno"]
    more = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(junk)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.union(more), SF).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**6]
    assert len(kept) > 0.97 * docs.count()


def test_pipeline_one_of_each_group(spark):
    """Repeated rows, shared ids and null ids: one row of each group."""
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d = (base(rng, 80) for _ in range(4))
    rows = [(1, a), (1, a), (1, a + " end"), (2, b), (2, c), (None, b), (None, d), (None, d), (None, d + " end"), (3, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert len(kept) == 4 and {(2, b), (2, c)} < set(kept)
    assert sum(i == 1 for i, _ in kept) == 1 and sum(i is None for i, _ in kept) == 1


def test_lines_by_text_id(spark):
    """Ids that aren't numbers order by their text, a null is the last; the largest number is kept."""
    rows = spark.createDataFrame([("b", "One and the same line here"), ("a", "one and the same line here"), (None, "One and the  same line here")], "doc_id string, text string")
    assert {r.doc_id: r.n_lines_removed for r in line_dedup.dedup(rows).collect()} == {"a": 0, "b": 1, None: 1}
    rows = spark.createDataFrame([(2**63 - 1, "A line"), (1, "B other words")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup(rows).collect()} == {2**63 - 1, 1}


def test_lines_in_a_large_bucket(spark):
    """More lines of one SimHash than a bucket compares in all pairs: alike ones meet through the
    bucket's first line, those unlike it meet each other."""
    alike = [f"item {k:04d} of the long list of parts that are in store today" for k in range(300)]
    apart = [f"item {k:018d} of the {k * 7919 % 10**18:018d} list" for k in range(10**17, 10**17 + 2)]
    rows = spark.createDataFrame([(x,) for x in [*alike, *apart]], "face string").withColumn("h", F.xxhash64("face"))
    found = [tuple(r) for r in line_dedup.links(rows).collect()]
    least, of = min(r.h for r in rows.where(F.col("face").isin(alike)).collect()), {r.h: r.face for r in rows.collect()}
    assert {b for a, b in found if a == least} == {h for h, x in of.items() if x in alike and h != least}


def test_suffixes_of_crowded_ranks(spark, monkeypatch):
    """Edited copies, with ranks that one task compares and with ranks that spread over tasks."""
    rng = random.Random(12)
    text = base(rng, 400)
    texts = [text, *(text[:p] + base(rng, 2) + text[p + 3 :] for p in rng.sample(range(len(text) - 9), 12)), text[500:900] * 2, None]
    want, seen = [], set()
    for t in texts:
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        want.append(bytes(x for p, x in enumerate(raw) if p not in gone))
    for crowd in (suffix_dedup.CROWD, 3, 0):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(make(spark, texts)).collect()}
        assert [got[k] for k in range(len(texts))] == want, crowd


def test_line_signatures(spark):
    """SimHashes of lines longer than a lane counts; no Python runs on the executors; lines that
    differ in digits only have few anchors in common."""
    faces = ["ab " * 14000 + "ab", "ab " * 28000 + "ab", *(f"{k * 7919 % 10**10:010d} {k:05d}" for k in range(200))]
    rows = spark.createDataFrame([(x,) for x in faces], "face string").withColumn("h", F.xxhash64("face"))
    made = line_dedup.simhashes(rows)
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
    got = {r.h: r for r in made.collect()}
    of = {r.face: got[r.h] for r in rows.collect()}
    assert of[faces[0]].sim == of[faces[1]].sim and of[faces[0]].anchors == of[faces[1]].anchors
    numbers = [a for f in faces[2:] for a in of[f].anchors]
    assert len(set(numbers)) > 0.8 * len(numbers)


def test_lines_of_symbols(spark):
    """Unlike lines whose words all carry the same few symbols are no candidates."""
    rng = random.Random(13)
    faces = [" ".join(w + rng.choice(["###", "***", "$$$", "%%%", "&&&"]) for w in base(rng, 60).split(" ")) for _ in range(30)]
    rows = spark.createDataFrame([(x,) for x in faces], "face string").withColumn("h", F.xxhash64("face"))
    sims = [r.sim for r in line_dedup.simhashes(rows).collect()]
    apart = [((a ^ b) & (2**64 - 1)).bit_count() for k, a in enumerate(sims) for b in sims[:k]]
    assert len(sims) == 30 and sum(x > 18 for x in apart) > 0.95 * len(apart)


def test_line_similarity_by_pieces(spark):
    """The verdict is that of the edit distance of the whole lines, with repeated phrases, moved
    parts and edits about the limit too; long edited copies take no square of their length."""
    rng = random.Random(14)
    pairs = [("", "a"), ("abc", "abd"), ("one line", "one line")]
    for n in range(4, 60, 4):
        for share in (0.0, 0.05, 0.15, 0.2, 0.25, 0.5, 1.0):
            a = list(base(rng, n)) if n % 8 else list((base(rng, 3) + " ") * (n // 3))
            b = [x if rng.random() > share else rng.choice(["", "z", x + "z"]) for x in a]
            pairs.append(("".join(a), "".join(b)))
            pairs.append(("".join(a), "".join(a[len(a) // 2 :] + a[: len(a) // 2])))
            pairs.append(("".join(a), "".join(a[: len(a) * 9 // 10])))
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, x string, y string")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - 0.8) + 1e-9).cast("int")
    want = {r.k for r in rows.where(F.call_function("levenshtein", F.col("x"), F.col("y")) <= most).collect()}
    assert {r.k for r in line_dedup._similar(rows, "x", "y", 0.8).collect()} == want and 0.2 < len(want) / len(pairs) < 0.9
    # 200 pairs of 20,000 characters: 8e10 cells as wholes
    words = [base(rng, 4000).split(" ") for _ in range(200)]
    far = spark.createDataFrame([(" ".join(w), " ".join(x if k % 20 else "new" for k, x in enumerate(w))) for w in words], "x string, y string")
    began = time.time()
    assert line_dedup._similar(far, "x", "y", 0.8).count() == 200 and time.time() - began < 60


def test_line_tables_are_given_back(spark):
    """Once the lines that go are known, no table of the lines' texts or SimHashes is left."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    rng = random.Random(15)
    docs = make(spark, ["\n".join(base(rng, 40) for _ in range(10)) for _ in range(200)])
    line_dedup.dedup(docs).count()
    left = sum(p.stat().st_size for d in set(shared.iterdir()) - before for p in d.rglob("*.parquet"))
    assert left < 0.2 * sum(len(r.text) for r in docs.collect())
