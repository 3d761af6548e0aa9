"""The corpus pipeline on odd rows, the linear models in plain Python, and what the entry does without a package."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import arrow, linear, quality_model, quality_rules, queries

SF = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).resolve().parents[2])


# ---- the pipeline ----

@pytest.fixture(scope="module")
def clashing(odd_docs):
    """Odd rows whose columns have the names of everything that the operators make."""
    names = ("score_", "score__", "__score", "n_lines", "n_dropped", "n_words", "hit_items", "hit_starts", "hit_ends", "class_id", "mark", "gone", "ids", "decoded", "label", "hash")
    return odd_docs.drop("n_words", "hit_items").withColumns({c: F.lit(f"own {c}") for c in names}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, clashing, name, stage):
    out = stage(spark, clashing, SF)
    rows, before = out.collect(), clashing.collect()
    assert stage(spark, clashing.limit(0), SF).count() == 0
    if name == "sentencepiece":
        assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and len(rows) == len(before)
        assert all(r.round_trip for r in rows) and all(r.n_tokens == 0 for r in rows if r.doc_id in (20, 21))
        return
    assert out.columns == clashing.columns
    for c in ("score_", "__score", "n_lines", "n_words", "hit_items", "mark", "ids"):
        assert {r[c] for r in rows} == {f"own {c}"}
    ids = lambda found: sorted((r.doc_id for r in found), key=str)
    if name == "line_dedup":
        assert ids(rows) == ids(before) and all(r.n_chars == len(r.text or "") for r in rows)
        assert any(r.text is None for r in rows)
    if name == "ngram_jaccard_join":
        assert ids(rows) == ids(r for r in before if r.doc_id not in (24, 26, *range(1, 8)) or r.doc_id in {x.doc_id for x in rows})
        assert {20, 21, 22, None, 25, 30} <= {r.doc_id for r in rows} and 26 not in {r.doc_id for r in rows}
        assert sum(r.doc_id == 30 for r in rows) == 2
    if name == "decontamination":
        assert ids(rows) == ids(before)


def test_the_pipeline_is_its_stages(spark, tmp_path):
    """The whole run, against the stages' own results put together, and what stays of its files."""
    made = len(arrow._made)
    out = {r.doc_id: (r.n_tokens, r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(arrow._made) <= made + 1  # only the stages' results are left
    from test_operators import LOW, words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = queries.op9_quality_model(spark, SF)
    kept = docs.join(scored.where("score >= 0.3").select("doc_id"), "doc_id", "left_semi").collect()
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)
    holders = {}
    for r in kept:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(r.doc_id)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    texts = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if keeper.get(key(x), r.doc_id) == r.doc_id) for r in kept}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for d, t in texts.items() for w in [words(t)]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * (c := len(x & y)) >= 4 * (len(x) + len(y) - c):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    left = [d for d in order if find(d) == d]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    want = {d for d in left if clean(words(texts[d]))}
    assert out.keys() == want
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_FILE)
    assert all(out[d][1] == library.encode(texts[d]) for d in want)


# ---- the models, one number at a time ----

def sample_of(spark, bits, sizes, characters):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = linear.features(linear.training_rows(docs, labels, "quality", 200), bits, sizes, characters).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    order = np.random.default_rng(7).permutation(len(rows))
    return docs, labels, [(rows[i].y, list(rows[i].idx), list(rows[i].val)) for i in order]


def logistic(x):
    return 1 / (1 + math.exp(-min(max(x, -40), 40)))


def test_leader_against_plain_python(spark):
    s = quality_model.Settings(max_rows=200)
    docs, labels, sample = sample_of(spark, s.bits, quality_model.SIZES, [])
    assert 20 < len(sample) <= 200
    z, n = {}, {}

    def weight(i):
        shrunk = math.copysign(max(abs(z.get(i, 0.0)) - s.l1, 0), z.get(i, 0.0))
        return -shrunk / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for y, idx, val in sample:
            x = {**{i: v * s.scale for i, v in zip(idx, val)}, "one": 1.0}
            w = {i: weight(i) for i in x}
            p = logistic(sum(w[i] * x[i] for i in x))
            for i in x:
                g = (p - y) * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    model = quality_model.fit_quality(docs, labels, settings=s)
    assert max(abs(model.weights[i] - weight(i)) for i in z if i != "one") < 1e-6 and abs(model.weights[-1] - weight("one")) < 1e-6
    # and the score of each text, from its own n-grams
    rows = docs.select("doc_id", "text", F.lit(0).alias("y"))
    vectors = {r.doc_id: zip(r.idx, r.val) for r in linear.features(rows, s.bits, quality_model.SIZES, []).collect()}
    for r in quality_model.score_quality(docs.select("doc_id", "text"), model).collect():
        margin = sum(weight(i) * v for i, v in vectors[r.doc_id])
        assert abs(r.score - logistic(s.scale * margin + weight("one"))) < 1e-5


def test_rules_against_plain_python(spark):
    s = quality_rules.Settings(max_rows=200)
    docs, labels, sample = sample_of(spark, s.bits, quality_rules.SIZES, quality_rules.CHARACTERS)
    learn, keep = [r for i, r in enumerate(sample) if i % 4], sample[::4]
    w, squares = {}, {}
    for _ in range(s.epochs):
        for y, idx, val in learn:
            x = {**{i: v * s.scale for i, v in zip(idx, val)}, "one": 1.0}
            p = logistic(sum(w.get(i, 0.0) * x[i] for i in x))
            for i in x:
                g = (p - y) * x[i] + s.decay * w.get(i, 0.0)
                squares[i] = squares.get(i, 1e-3) + g * g
                w[i] = w.get(i, 0.0) - s.rate * g / math.sqrt(squares[i])
    margins = [s.scale * sum(w.get(i, 0.0) * v for i, v in zip(idx, val)) for _, idx, val in keep]
    good = sum(y for y, _, _ in keep)
    target = [(good + 1) / (good + 2) if y else 1 / (len(keep) - good + 2) for y, _, _ in keep]
    model = quality_rules.fit_rules(docs, labels, s)
    assert max(abs(model.weights[i] - w[i]) for i in w if i != "one") < 1e-6

    def loss(a, b):
        p = [logistic(a * m + b) for m in margins]
        return 0.5e-3 * (a - 1) ** 2 - sum(t * math.log(q) + (1 - t) * math.log(1 - q) for t, q in zip(target, p))

    least = loss(model.slope, model.constant)  # slope and constant stand where the loss is least
    assert all(loss(model.slope + da, model.constant + db) >= least - 1e-9 for da, db in ((1e-2, 0), (-1e-2, 0), (0, 1e-2), (0, -1e-2)))
    rows = docs.select("doc_id", "text", F.lit(0).alias("y"))
    vectors = {r.doc_id: zip(r.idx, r.val) for r in linear.features(rows, s.bits, quality_rules.SIZES, quality_rules.CHARACTERS).collect()}
    for r in quality_rules.apply_rules(docs.select("doc_id", "text"), model).collect():
        p = logistic(model.slope * s.scale * sum(w.get(i, 0.0) * v for i, v in vectors[r.doc_id]) + model.constant)
        assert abs(r.probability - p) < 1e-5 and r.kept == (not r.base_failed and r.probability >= s.threshold)


def test_models_of_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", f"{'good prose here' if i % 2 else 'buy now !!!'} {i}") for i in range(40)], "doc_id string, text string")
    labels = docs.selectExpr("doc_id", "cast(substr(doc_id, 2) as int) % 2 as quality")
    model = quality_model.fit_quality(docs, labels)
    scores = {r.doc_id: r.score for r in quality_model.score_quality(docs, model).collect()}
    assert min(v for k, v in scores.items() if int(k[1:]) % 2) > max(v for k, v in scores.items() if not int(k[1:]) % 2)


# ---- the entry, and files that are written on the way ----

@pytest.mark.parametrize("package", ["xxhash", "zstandard"])
def test_the_entry_without_a_package(package):
    told = f"import sys; sys.modules['{package}'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.oracle_sql()) > 50)"
    done = subprocess.run([sys.executable, "-c", told], cwd=ROOT, capture_output=True, text=True, timeout=120)
    many, text, sql = done.stdout.split()
    assert int(many) > 80 and text == "False" and sql == "True", done.stderr


def test_written_tables_are_removed(spark):
    with arrow.removed(spark):
        path = Path(arrow.written(spark.range(5), "some")._jdf.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
        assert path.exists()
    assert not path.exists()
