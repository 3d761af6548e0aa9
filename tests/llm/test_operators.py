"""The text operators against brute force, round trips and the format's own library."""

import dataclasses
import hashlib
import itertools
import pickle
import random
import re
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from pulsegrid.llm import bloom, chat, decontaminate, exact_links, line_dedup, linear, ngram_join, piece_fst, pieces, quality_model, quality_rules, queries, sharding, token_counts, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


# ---- 1: line dedup ----

def test_lines_against_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(d)
    keeper = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v - {None}) >= 5}
    want = Bag()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        want[d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)] += 1
    out = line_dedup.dedup_lines(odd_docs)
    assert Bag((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
    assert keeper and set(odd_docs.columns) <= set(out.columns)
    clashes = odd_docs.withColumns({c: F.lit(c) for c in ("mark", "gone", "owner", "note", "touched", "touched_", "__gone", "__doc", "hash")})
    full = line_dedup.dedup_lines(clashes, most=3, range_bytes=64)  # many ranges, filters that are full at once, several rounds
    assert Bag((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in full.collect()) == want
    assert full.select("mark", "touched_", "__doc").distinct().collect() == [("mark", "touched_", "__doc")]
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 10, 1 << 14, 1 << 20])
def test_few_lines_are_falsely_suspected(size):
    """However small the filters are to begin with."""
    rng = np.random.default_rng(1)
    lines = rng.integers(0, 1 << 63, 400_000).astype(np.uint64)
    filters = bloom.Twice(size)
    found = np.concatenate([filters.add(part) for part in np.array_split(lines, 50)])
    assert len(found) < 0.05 * len(lines)
    again = np.concatenate([filters.add(part) for part in np.array_split(lines[:1000], 3)])
    assert set(lines[:1000].tolist()) <= set(again.tolist()) | set(found.tolist()) and len(filters.add(lines[:1000])) == 0


def test_texts_without_lost_lines_are_not_shuffled(spark):
    rows = [(i, "own text of a document, of no interest to any other one, %d\n" % i * 40) for i in range(400)]
    rows += [(1000 + i, "the line that five documents and more of them hold\nown %d" % i) for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS)
    out = line_dedup.dedup_lines(docs)
    assert out.agg(F.sum("n_dropped")).first()[0] == 8 and out.count() == 409
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join") == 1 and "Union" in joined


# ---- 2: WARC ----

def test_archives_round_trip(spark, tmp_path):
    body = "<html>" + "payload " * 50
    rows = [(i, f"http://x/{i}", body + str(i % 40)) for i in range(300)]
    rows += [(400, None, None), (401, "http://a b\n", ""), (None, "u", body + "0"), (402, "big", "é" * 3_000_000), (-5, "neg", body + "1"), (403, "u", "alone"), (403, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("first", F.lit(1))
    path = str(tmp_path / "warc")
    warc.write_archives(pages.repartition(3), path, per_archive=64, sample_bytes=8 << 10)
    got = warc.read_archives(spark, path).collect()
    least = {}
    for p, _, h in rows:
        least[h or ""] = min([x for x in (least.get(h or ""), p) if x is not None], default=None)
    want = Bag()
    for p, _, h in rows:
        raw = (h or "").encode()
        first = least[h or ""]
        want[p, len(raw), warc.payload_digest(raw), "response" if p == first else "revisit", None if p == first else first] += 1
    assert Bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(hashlib.sha1(r.payload).digest() for r in got if r.payload is not None)
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    assert any(b[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(b[4:8], "little") > 1000 for b in files)
    with pytest.raises(zstandard.ZstdError):  # records need the archive's own dictionary
        big = max(files, key=len)
        at = warc.frame_end(memoryview(big), 0) + 8
        zstandard.ZstdDecompressor().decompress(big[at : warc.frame_end(memoryview(big), at)])
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    big_only = str(tmp_path / "min")
    warc.write_archives(pages, big_only, min_bytes=1_000_000)
    assert warc.read_archives(spark, big_only).where("record_type = 'revisit'").count() == 0


# ---- 3 and 8: pieces ----

@pytest.fixture(scope="module")
def texts():
    import duckdb

    rng = random.Random(3)
    found = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    found += ["", " ", "   a", "日本 語\n\t", "\x00", " " * 40 + "the" + " " * 33, "▁a▁▁b", "😀 é", "a" * 3000, "12345 67", "x" + " " * 17 + "日"]
    alphabet = "abcdefghijklmnopqrstuvwxyz   ABC.,é日😀012\n\t▁"
    return found + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_encoding_is_what_the_library_gives(spark, texts):
    vocabulary = pieces.load_vocabulary(queries.PIECE_FILE)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_FILE)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], DOCS).withColumn("ids", F.lit("other"))
    out = piece_fst.decode_pieces(piece_fst.encode_pieces(docs, vocabulary), vocabulary)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[-1]["ids"] == [] and rows[-1].decoded == ""
    for i, want in enumerate(library.encode(texts, num_threads=1)):
        assert rows[i]["ids"] == want, texts[i][:80]
        assert rows[i].decoded == texts[i].replace("▁", " ")
    both = piece_fst.round_trip(docs, vocabulary)
    assert {r.doc_id: r for r in both.collect()} == rows and both.columns == out.columns
    assert piece_fst.encode_pieces(docs.limit(0), vocabulary).count() == piece_fst.round_trip(docs.limit(0), vocabulary).count() == 0


def test_unigram_counts_and_paths(texts):
    vocabulary = pieces.load_vocabulary(queries.PIECE_FILE)
    model = pb.ModelProto()
    with open(queries.PIECE_FILE, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # the library adds in single precision, which -1e9 drowns
        p.score = max(p.score, -40000)
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(model.SerializeToString())
    scores = np.maximum(vocabulary.scores, np.float32(-40000))
    unigram = dataclasses.replace(vocabulary, scores=scores, merges=False)
    lines = [x for t in texts for x in t.split("\n") if len(x) < 300]
    want = library.encode(lines, num_threads=1)
    assert token_counts.Counter(unigram).counts(lines).tolist() == [len(w) for w in want]
    ids, first = piece_fst.Encoder(unigram).encode(lines)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want


@pytest.mark.parametrize("rule", ["nmt_nfkc_cf", "nfkc", "identity"])
def test_character_maps_are_those_of_the_library(texts, tmp_path, rule):
    model, norm = pb.ModelProto(), pb.ModelProto()
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    with open(queries.PIECE_FILE, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = norm.normalizer_spec.precompiled_charsmap
    (tmp_path / "m").write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    vocabulary = pieces.load_vocabulary(str(tmp_path / "m"))
    odd = ["ＡＢＣ ﬁ ½ ｶﾞｷﾞ", "e\u0301a\u0300\u0323", "x\u3000y\u00a0z\u200b", "İSTANBUL ẞ", "가각힣", "\u00ad\u0007tab\there", "㌀㍿ ™", "é" * 50]
    some = odd + texts[::7]
    ids, first = piece_fst.Encoder(vocabulary).encode(some)
    want = library.encode(some, num_threads=1)
    for i, w in enumerate(want):
        assert ids[first[i] : first[i + 1]].tolist() == w, some[i][:60]
    assert token_counts.Counter(vocabulary).counts(some).tolist() == [len(w) for w in want]


def test_counts_are_those_of_the_encoder(spark, texts):
    vocabulary = pieces.load_vocabulary(queries.PIECE_FILE)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_FILE)
    more = texts + [" " * n + w + " " * m for n in range(20) for m in (0, 1, 17) for w in ("", "日", "the", "x 日")]
    got = token_counts.Counter(vocabulary).counts(more).tolist()
    for text, n, want in zip(more, got, library.encode(more, num_threads=1)):
        assert n == len(want), text[:80]
    counts = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, SF).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in queries.op3_sentencepiece(spark, SF).collect()}


def test_counts_in_a_table(spark, odd_docs):
    out = token_counts.count_tokens(odd_docs, pieces.load_vocabulary(queries.PIECE_FILE))
    rows = {r.doc_id: r.n_tokens for r in out.collect()}
    assert out.count() == odd_docs.count() and rows[20] == rows[21] == 0 and rows[23] > 30_000


# ---- 4: decontamination ----

def test_windows_against_brute_force(spark, odd_docs):
    rng = random.Random(5)
    pool = ["a", "b", "c", "dé", "E", "x1"]
    say = lambda n: " ,".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.randint(9, 30))) for i in range(20)] + [(30, "a b c"), (31, "x1"), (32, None), (33, "--"), (34, "a b c"), (None, "b b b b")]
    docs = [(i, say(rng.randint(0, 400)) + "\n" + (items[i % 20][1]).upper() + "! " + say(3)) for i in range(60)] + [(70, None), (71, "")]
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + 10]), set()).add("null" if item is None else str(item))
    want = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for p, who in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= who
        want[d] = (len(w), len(hit), sorted(found))
    table = spark.createDataFrame(docs, DOCS).withColumn("item", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (32 << 20, 200):  # at once, and part by part
        out = decontaminate.find_contamination(table, bench, part_bytes=part_bytes).withColumn("n_hit", decontaminate.hit_words())
        assert {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in out.collect()} == want
    assert decontaminate.find_contamination(odd_docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0


def test_parts_of_a_benchmark_are_bounded(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(3 + i % 20))) for i in range(200)] + [(500, "said again and again " * 20)] * 100
    items += [(501, "much longer than a part " * 200)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    docs = spark.createDataFrame([(i, text) for i, text in items[::7] + items[-1:]], DOCS)
    seen, index = [], decontaminate.index_items
    monkeypatch.setattr(decontaminate, "index_items", lambda part, window: seen.append(part) or index(part, window))
    found = lambda **more: Bag((r.doc_id, r.n_words, str(r.hit_starts), str(r.hit_ends), str(r.hit_items)) for r in decontaminate.find_contamination(docs, bench, **more).collect())
    whole = found()
    assert len(seen) == 1 and sorted(seen.pop()) == sorted({(str(i), text) for i, text in items})
    assert found(part_bytes=4000) == whole
    assert sorted(sum(seen, [])) == sorted({(str(i), text) for i, text in items})
    sizes = [sum(len(i) + len(text) for i, text in part) for part in seen]
    assert all(size <= 4000 or len(part) == 1 for size, part in zip(sizes, seen))
    assert len(seen) <= 2 * sum(sizes) / 4000 + 1


def test_an_index_is_bounded_by_its_items():
    rng = np.random.default_rng(1)
    vocabulary = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(30_000)])
    items, size = [], 0
    while size < 32 << 20:
        text = " ".join(vocabulary[rng.integers(0, 30_000, rng.integers(5, 3000))])
        items.append((str(len(items)), text))
        size += len(text)
    held, matchers = decontaminate.index_items(items, 10)
    assert len(pickle.dumps((held, matchers), protocol=5)) < 200e6
    probe = " ".join(items[7][1].split()[5:15])
    found = decontaminate._scan(pa.RecordBatch.from_pydict({
        "text": [f"x {probe} y"], "hit_starts": pa.array([[]], pa.list_(pa.int32())), "hit_ends": pa.array([[]], pa.list_(pa.int32())), "hit_items": pa.array([[]], pa.list_(pa.string()))}), (held, matchers))
    assert found["hit_items"].to_pylist() == [["7"]] and found["hit_starts"].to_pylist() == [[1]] and found["hit_ends"].to_pylist() == [[11]]


# ---- 5 and 9: quality ----

def test_base_counts_against_brute_force(odd_docs):
    space = " \t\n\v\f\r"
    samples = [r.text for r in odd_docs.collect()] + ["a b c a b c a b c", "x\nx\n \nx #1 <b>|", "a a a a", "\x00 \x00 \x00 \x00", "é$é %"]
    got = quality_rules.base_counts(pa.array(samples, pa.string()))
    for i, text in enumerate(t or "" for t in samples):
        w = [x for x in re.split(f"[{space}]+", text) if x]
        seen = Bag(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        inside = {j + k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(space)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(int(got[c][i]) for c in names) == want


@pytest.mark.parametrize("name", ["op9_quality_model", "op5_quality_rules"])
def test_held_out_quality(spark, name):
    sf = "/root/testdata/sf0.01"
    out = queries.REGISTRY[name](spark, sf).withColumn("held", linear.held_out_id())
    both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held")
    verdict = "predicted = 1" if name.startswith("op9") else "kept"
    right = both.where(f"({verdict}) = (quality = 1)" if name.startswith("op9") else f"base_failed or ({verdict}) = (quality = 1)").count()
    assert right / both.count() >= 0.97


def test_scores_without_labels_or_texts(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_model.fit_quality(odd_docs, none)
    out = quality_model.score_quality(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(r.score == 0.5 for r in out)
    rules = quality_rules.apply_rules(odd_docs, quality_rules.fit_rules(odd_docs, none))
    assert rules.where("n_words = 0 and not base_failed").count() == 0 and rules.count() == odd_docs.count()


# ---- 6: chat ----

def test_chats_read_back(spark):
    rng = random.Random(9)
    bits = ["\\", "#", "###", "### user: ", "</turn>", "</turn>\n", "<\\/turn>", "\n", "a", ":", "$1", "é", "\\\\"]
    said = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\\", None, "### x"]), rng.choice([None, said(), said()])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(98, 1, "long role " * 20_000, "x")]
    rows += [(None, 1, "user", "x"), (99, 1, "user", "b"), (99, 1, "user", "a"), (99, None, "user", "first"), (99, 1, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    read = chat.read_chats(chat.format_chats(turns)).withColumn("loss", chat.loss_text()).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == want
    for r in read:
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert r.formatted.count("</turn>\n") == len(want[r.conv_id])
        at, learnt = 0, []
        for n, loss in r.loss_mask:
            learnt += [re.sub(r"(?s)\\(.)", r"\1", r.formatted[at : at + n])] if loss else []
            at += n
        assert at == len(r.formatted) and learnt == [x for role, x in want[r.conv_id] if role == "assistant"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_loss_is_read_through_the_mask(spark, monkeypatch):
    rows = [(1, t, ("user", "assistant")[t % 2], "é😀</turn>\\" * (t * 7)) for t in range(12)]  # turns end inside spans and at their borders
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chats.select(chat.loss_text()).first()[0] == "".join(text for _, _, role, text in rows if role == "assistant")
    shifted = F.concat(F.array(F.struct(F.lit(1).alias("n"), F.lit(False).alias("loss"))), "loss_mask")  # a mask one code point late
    assert chats.withColumn("loss_mask", shifted).select(chat.loss_text()).first()[0] != chats.select(chat.loss_text()).first()[0]
    right = {r.conv_id: r.loss_sha256 for r in queries.op6_chat(spark, SF).collect()}
    whole = chat.format_chats
    monkeypatch.setattr(chat, "format_chats", lambda turns: whole(turns, learn="user"))  # marks the wrong texts, formats the same
    wrong = {r.conv_id: r.loss_sha256 for r in queries.op6_chat(spark, SF).collect()}
    # the planted one says the same twice
    assert right.keys() == wrong.keys() and all(right[c] != wrong[c] for c in right if c != -7)


# ---- 7: n-gram join ----

def near_corpus():
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    common = prose(60)
    docs = []
    for _ in range(12):
        base = prose(rng.randint(60, 300))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randint(0, 99)
            docs.append(" ".join(copy))
    docs += [" ".join(prose(50) + common) for _ in range(150)]
    large = prose(250)
    for i in range(400):
        docs.append(" ".join(large[:-2] + [f"u{i}", f"v{i % 7}"]))
    docs += [docs[0]] * 3 + [docs[0].upper() + "."]
    return [(i, t) for i, t in enumerate(docs)]


def test_join_against_brute_force(spark, odd_docs):
    rows = near_corpus() + [(10_000 + (r.doc_id if r.doc_id is not None else 0), r.text) for r in odd_docs.where("doc_id is not null").distinct().collect()]
    rows = list(dict(rows).items())
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root, links = {d: d for d in sets}, Bag()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * (c := len(x & y)) >= 4 * (len(x) + len(y) - c):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    docs = spark.createDataFrame(rows, DOCS).withColumn("rid", F.lit(0)).withColumn("cluster", F.lit(0))
    for join in (ngram_join.Join(), ngram_join.Join(small=16, set_block=32), ngram_join.Join(small=8, set_block=450)):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_jaccard_join(docs, join).collect()}
        assert got == {d: (find(d), links[d]) for d in sets}


def test_copies_of_sets_grow_with_the_members(spark, monkeypatch):
    """A group of near copies is compared with one of them, not each with each."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(250)]
    moved = Bag()
    for name in ("compared_links", "differences"):
        whole = getattr(exact_links, name)
        monkeypatch.setattr(exact_links, name, lambda rows, *a, whole=whole: moved.update({size[0]: rows.count()}) or whole(rows, *a))
    seen, size = [], [0]
    for n in (1000, 4000):
        size[0] = n
        docs = spark.createDataFrame([(i, " ".join(base[:-2] + [f"u{i}", f"v{i % 7}"])) for i in range(n)], DOCS).repartition(8)
        out = ngram_join.ngram_jaccard_join(docs).select("class_id", "n_links").distinct().collect()
        assert [tuple(r) for r in out] == [(0, n - 1)]
        seen.append(moved[n])
    assert 0 < seen[0] and seen[1] <= 4.5 * seen[0]


def test_links_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five SIX"), (None, "one two three four five six")], "doc_id string, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == {("a", "a", 1), ("b", "a", 1), (None, None, 0)}


def test_join_of_odd_rows(spark, odd_docs):
    out = ngram_join.ngram_jaccard_join(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert [(r.class_id, r.n_links) for r in out if r.doc_id == 30] == [(30, 1)] * 2
    assert [(r.class_id, r.n_links) for r in out if r.doc_id is None] == [(None, 0)]
    assert {r.doc_id: r.class_id for r in out}[26] == 25 and {r.doc_id: r.n_links for r in out}[21] == 0
    assert ngram_join.ngram_jaccard_join(odd_docs.limit(0)).count() == 0


# ---- 10: sharding ----

def test_shards(spark, odd_docs):
    rows = [(i, "hot") for i in range(700)] + [(1000 + i, f"pair{i // 2}") for i in range(400)] + [(2000 + i, f"one{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit(1)).withColumn("shard", F.lit(1))
    got = sharding.propagate_shards(docs).toPandas()
    counts = got["shard"].value_counts()
    assert len(got) == 2000 and counts.max() - counts.min() <= 1 and len(counts) == 8
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    pairs = got[(got.doc_id >= 1000) & (got.doc_id < 2000)]
    assert (pairs.groupby((pairs.doc_id - 1000) // 2)["shard"].nunique() == 1).mean() > 0.9
    hot = got[got.doc_id < 700]["shard"].value_counts()
    assert hot.nlargest(3).sum() > 600  # three shards at least, by the quota
    odd = sharding.propagate_shards(odd_docs).toPandas()
    assert len(odd) == odd_docs.count() and odd["shard"].value_counts().reindex(range(8), fill_value=0).max() <= -(-len(odd) // 8)
    assert sharding.propagate_shards(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("linked", [95, 100])
@pytest.mark.parametrize("size", [2, 5])
def test_groups_stay_whole_in_full_shards(spark, linked, size):
    docs = spark.range(8000).selectExpr(
        "id as doc_id", f"if(id < {80 * linked}, concat('group ', id div {size}), concat('one ', id)) as text"
    )
    got = sharding.propagate_shards(docs).toPandas()
    assert list(got["shard"].value_counts()) == [1000] * 8
    of_groups = got[got.doc_id < 80 * linked]
    assert (of_groups.groupby(of_groups.doc_id // size)["shard"].nunique() == 1).all()  # a perfect packing exists


def test_groups_are_cut_by_the_quotas_alone(spark):
    sizes = [2700, 900, 900, 700] + [3] * 500 + [2] * 650  # all rows linked; 2,700 take two shards and 700 of a third
    rows = [(k, f"group {k}") for k, n in enumerate(sizes) for _ in range(n)]
    got = sharding.propagate_shards(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) == 8000 and list(got["shard"].value_counts()) == [1000] * 8
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    held = got.groupby("doc_id")["shard"].nunique()
    assert held[0] == 3 and (held[1:] > 1).sum() <= 4


def brute_rounds(links, kinds, shard, shards):
    """The same rules, one document at a time."""
    cuts = []
    while True:
        want = {}
        for v in {a for a, _ in links}:
            seen = Bag(shard[b] for a, b in links if a == v)
            to = max(seen, key=lambda t: (seen[t], -t))
            hub = min(b for a, b in links if a == v and shard[b] == to)
            if to != shard[v]:
                want[v] = (to, hub)
        cuts.append(len(want))
        if len(cuts) > 1 and cuts[-1] >= cuts[-2]:
            return cuts
        moved = False
        for kind in set(kinds.values()):
            counts = {}
            for v, (to, hub) in want.items():
                if kinds[v] == kind:
                    counts.setdefault((shard[v], to), [0] * sharding.WISH_BUCKETS)[bucket[hub]] += 1
            upto = sharding.granted(counts, shards)
            into, out, taken = Bag(), Bag(), Bag()
            blocks = max(16, -(-cuts[-1] // sharding.RANK_BLOCK))
            for v in sorted(want, key=lambda v: (hashed[v] % blocks, v)):
                to, hub = want[v]
                if kinds[v] != kind or (shard[v], to) not in upto:
                    continue
                whole, rest = upto[shard[v], to]
                taken[shard[v], to] += bucket[hub] == whole
                if bucket[hub] < whole or (bucket[hub] == whole and taken[shard[v], to] <= rest):
                    out[shard[v]] += 1
                    into[to] += 1
                    shard[v], moved = to, True
            assert into == out  # quotas are kept
        if not moved:
            return cuts


bucket, hashed = {}, {}


def test_propagation_against_brute_force(spark):
    rng = random.Random(6)
    rows = list(range(300))
    links = sorted({(max(a, b), min(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(400)) if a != b})  # any graph
    links += [(i, i - i % 5) for i in range(300) if i % 5 and (i, i - i % 5) not in links]
    kinds, shard = {v: 2 + v % 3 for v in rows}, {v: rng.randrange(4) for v in rows}
    hashed.update({r.row: r.h for r in spark.createDataFrame([(v,) for v in rows], "row long").select("row", F.xxhash64("row").alias("h")).collect()})
    bucket.update({v: h % sharding.WISH_BUCKETS for v, h in hashed.items()})
    labels = spark.createDataFrame([(v, kinds[v], shard[v]) for v in rows], "row long, kind int, shard int")
    got, open_ = sharding.propagate(labels, spark.createDataFrame(links, "row long, to long"), 4)
    cuts = brute_rounds(links, kinds, shard, 4)
    assert {r.row: r.shard for r in got.collect()} == shard and open_ == cuts


def test_cut_edges_fall_each_round(spark):
    docs = spark.range(20_000).selectExpr("id as row", "concat('g', id div 4) as grp", "4L as n")
    cuts = []
    out, room = sharding.linked_shards(docs, [2500] * 8, 20_000, cuts)
    assert cuts[0] > 12_000 and cuts[-1] < 2_000 and all(a > b for a, b in zip(cuts, cuts[1:])) and room == [0] * 8
    held = out.join(docs, "row").groupBy("grp").agg(F.countDistinct("shard").alias("k"))
    assert held.where("k > 1").count() == 0


# ---- pipeline and plans ----

def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns and out.count() <= seen.count(), name
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count() and last.where("not round_trip").count() == 0


@pytest.mark.parametrize("name", ["op6_chat", "op10_sharding"])
def test_native_plans_have_no_python(spark, name):
    text = queries.REGISTRY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop", "SinglePartition"))
