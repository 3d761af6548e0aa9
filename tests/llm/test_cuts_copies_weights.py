"""Fill-in-middle, near duplicates and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import bloom, fill_middle, importance, interning, near_dedup, queries
from pulsegrid.llm.arrow import mix
from pulsegrid.llm.wavelet import WaveletMatrix

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


# ---- 11: fill in the middle ----

def test_ranks_of_a_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 5, size).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(size + 1)
        for s in range(8):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
        some = np.concatenate([[0], np.cumsum(np.isin(symbols, (1, 4)))])
        k = np.arange(some[-1] + 1)
        low, high = np.zeros_like(k), np.full_like(k, size)
        assert (matrix.select_any((1, 4), k, low, high) == np.searchsorted(some, k)).all()


def brute_cut(doc_id, text):
    text = text or ""
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    u = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((u[0] % (len(t) + 1), u[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or u[2] % 100 >= 90:
        return len(t), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if u[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(t), "spm" if u[3] % 100 < 20 else "psm", len(p), len(m), out


def test_cuts_against_brute_force(spark, odd_docs):
    rng = random.Random(7)
    bits = ["<P>", "<S", ">", "<", "<M", "M>", "a", "Zz", " ", "é", "日", "😀", "\x00", "\n", "9"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(100, 1500)]
    docs = odd_docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1).cast("long")))
    docs = docs.withColumns({"form": F.lit("mine"), "output": F.lit(1), "draws": F.lit(2)})
    out = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Bag((r.doc_id, *brute_cut(r.doc_id, r.text)) for r in docs.collect())
    assert Bag((r.doc_id, r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == want
    assert all(r.back == (r.text or "") and r.draws == 2 for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    never = fill_middle.fill_in_middle(docs, fill_middle.Cuts(changed=0))
    assert never.where("form <> 'plain'").count() == 0


# ---- 12: near duplicates ----

def shingles(text, n=2):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if rows[a][0] is None or rows[b][0] is None or not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            continue
        c = len(x & y)
        if 100 * c >= percent * (len(x) + len(y) - c):
            root[max(find(a), find(b))] = min(find(a), find(b))
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    ids = [lowest.get(find(i)) for i in range(len(rows))]
    return Bag((d, len(sets[i]), ids[i], d == ids[i]) for i, (d, _) in enumerate(rows))


def near_corpus():
    """Copies of every closeness, a group of many that differ by some words, chains, and a common passage."""
    rng = random.Random(13)
    prose = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    passage, docs = prose(60), []
    for _ in range(60):
        base = prose(rng.randint(3, 200))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 99)}"
            docs.append(" ".join(copy))
    docs += [" ".join(prose(30) + passage) for _ in range(300)]
    large = prose(120)
    for _ in range(400):  # most pairs are near the border of similarity
        copy = list(large)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
        docs.append(" ".join(copy))
    chain = prose(80)
    for i in range(25):
        chain[3 * i] = f"step{i}"
        docs.append(" ".join(chain))
    docs += [docs[0]] * 4 + [docs[0].upper().replace(" ", " \t\n"), "one", "One", "one two", "ONE  two", "two one"]
    rng.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("plan", [near_dedup.Nearness(), near_dedup.Nearness(small=16, block=16), near_dedup.Nearness(small=4, block=500)])
def test_components_against_brute_force(spark, odd_docs, plan):
    rows = near_corpus() + [(10_000 + r.doc_id if r.doc_id is not None else None, r.text) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("rid", "node", "n", "c0", "label", "hash", "sketch", "chunk")}).repartition(5)
    out = near_dedup.near_duplicates(docs, plan).collect()
    got = Bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    want = brute_components(rows)
    want = Bag({(d, n, c, True if d is None else k): v for (d, n, c, k), v in want.items()})
    assert got == want


def test_near_duplicates_of_no_rows(spark, odd_docs):
    assert near_dedup.near_duplicates(odd_docs.limit(0)).count() == 0
    alone = near_dedup.near_duplicates(odd_docs.where("doc_id in (20, 21, 23)")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in alone} == {(20, 20, True), (21, 21, True), (23, 23, True)}


def test_pigeonhole_finds_all_pairs_within_the_radius(spark):
    """Signatures that differ in exactly 15 values, spread in every way, share a key, and a second one in another chunk."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 16, (400, 32)).astype(np.uint16)
    other = values.copy()
    for row in other:
        row[rng.choice(32, 15, replace=False)] ^= np.uint16(rng.integers(1, 1 << 16))
    assert near_dedup.Nearness().radius == 15
    names = [f"c{i}" for i in range(8)]
    frame = lambda v: spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(v.view(np.int64))], "rid long, " + ", ".join(f"{c} long" for c in names))
    a, b = frame(values), frame(other)
    shared = lambda keys: a.select("rid", F.explode(keys()).alias("k")).join(b.select("rid", F.explode(keys()).alias("k")), ["rid", "k"]).select("rid", "k.chunk")
    first = shared(near_dedup.chunk_keys).distinct()
    assert first.select("rid").distinct().count() == 400
    second = shared(near_dedup.second_keys).distinct().withColumnRenamed("chunk", "other")
    left = first.join(second, "rid").where("chunk <> other").select("rid", "chunk").distinct()
    assert left.count() == first.count()


def test_bloom_filters_have_room(spark):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("hash"))
    table = bloom.bloom_filter(keys, 200_000)
    inside = np.array([r.hash for r in keys.limit(5000).collect()], dtype=np.int64).view(np.uint64)
    assert bloom.known(table, inside).all()
    assert bloom.known(table, mix(np.arange(100_000, dtype=np.uint64))).mean() < 0.01


# ---- 13: importance ----

def grams(text, longest=3):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute_resample(docs, target, share=5, buckets=10_000, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Bag(), Bag()
    for table, counts in ((docs, s), (target, t)):
        for _, text in table:
            counts.update(map(bucket, grams(text)[0]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for d, text in docs:
        g, n = grams(text)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in g)
        rows.append((d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = share * len(fit) // 100
    return Bag((*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)) + Bag((*r[:4], None) for r in rows if r[4] < least)


def test_resampling_against_brute_force(spark, odd_docs):
    rng = random.Random(17)
    pool = [f"w{i}" for i in range(80)] + ["É", "日本", "x" * 70, "A1"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(n))
    rows = [(i, say(rng.randint(0, 120))) for i in range(100, 500)] + [(600, "same words " * 15)] * 40
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = [(i, say(30)) for i in range(20)] + [(99, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("weight", "score", "rank", "n_words", "_own")}).repartition(4)
    bench = spark.createDataFrame(target, "item_id long, text string")
    for share in (5, 60):
        out = importance.resample(docs, bench, importance.Resampling(draw=share)).collect()
        assert Bag((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out) == brute_resample(rows, target, share)
    assert importance.resample(docs.limit(0), bench).count() == 0
    none = importance.resample(docs, bench.limit(0)).collect()
    assert Bag((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in none) == brute_resample(rows, [])


def test_interning_tells_equal_hashes_apart(monkeypatch):
    data = np.frombuffer(b"the cat the dog \xc3\xa9 the cat " * 50, dtype=np.uint8)
    spans, raw = interning.Spans(data), data.tobytes()
    rng = np.random.default_rng(5)
    start, size = rng.integers(0, len(raw) - 100, 4000), rng.integers(0, 90, 4000)
    texts = [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist())]
    assert spans.xxhash64(start, size).tolist() == [xxhash.xxh64_intdigest(x) for x in texts]
    monkeypatch.setattr(interning.Spans, "xxhash64", lambda self, start, size: (size % 3).astype(np.uint64))  # nearly all keys collide
    table = interning.Interned(spans, start[:600], size[:600], 10_000)
    want = Bag(texts[:600])
    assert len(table.used) == len(want)
    for i, x in enumerate(texts[:600]):
        assert table.count[table.slot[i]] == want[x] and table.bucket[table.slot[i]] == zlib.crc32(x) % 10_000


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 50).alias("score")).repartition(7)
    out = importance.ranked(rows, 30).collect()
    want = sorted(((r.score, r.doc_id) for r in out), key=lambda r: (-r[0], r[1]))[:1500]
    assert [(r.score, r.doc_id) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 1501)) and len(out) == 5000
