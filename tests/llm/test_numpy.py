"""Language ID, LM scores, fingerprints, the n-gram join and the pipeline against brute force and on odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import arrays, fingerprints, graph, jaccard_join, langid, lm_scoring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n", "a", "é", "7 7 7", "x" * 300_000, "same text here now", "same text here now", "\x00 \U0001f600 z"]


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(t):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (t or "").encode())) if w]


def test_word_hashes():
    r = random.Random(3)
    text = "".join(r.choice(["ab", "Ab", "c", " ", "\n", "é", "\t", "xyz" * 50]) for _ in range(4000))
    for t in (text, "", "  ", "one", "long " + "q" * (arrays.BLOCK + 5) + " end", " ".join([text] * 200)):
        h, first = arrays.word_hashes(t.encode())
        own = words(t)
        assert len(h) == len(own)
        seen = {}
        for a, b in zip(own, h.tolist(), strict=True):
            assert seen.setdefault(a, b) == b
        assert len(set(seen.values())) == len(seen)


def test_counter():
    c = arrays.Counter(most=50)
    sent = collections.Counter()
    keys = np.random.default_rng(0).integers(0, 90, 3000).astype(np.uint64)
    for part in np.array_split(keys, 20):
        for k, n in c.add(part):
            sent.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    for k, n in c.rest():
        sent.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert sent == collections.Counter(keys.tolist())


def test_language(spark, docs):
    got = langid.identify_documents(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    odd = docs.union(spark.createDataFrame([(10_000 + i, t, None, None, 0) for i, t in enumerate([*ODD, "123 !!"])] + [(None, "the text", "en", None, 0)], DOCS)).withColumn("score", F.lit("clash"))
    by = {r["doc_id"]: r for r in langid.identify_documents(odd).collect()}
    assert len(by) == odd.select("doc_id").distinct().count()
    assert all((by[10_000 + i]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t)) for i, t in enumerate([*ODD, "123 !!"]))
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert langid.identify_documents(docs.limit(0)).count() == 0
    nothing = langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["lang_pred"] == "und" for r in nothing)


def check_base(rows, texts):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter()
    for i, t in texts:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    expected = collections.Counter()
    for i, t in texts:
        own = [*words(t), None]
        expected[i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 4)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == expected


def test_scores(spark, docs):
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "q q"), (7, "again"), (7, "again")], "doc_id long, text string"))
    rows = lm_scoring.score_documents(both).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in both.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.score_documents(both.limit(0)).count() == 0
    none = lm_scoring.score_documents(both.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2)).collect()
    assert none and all(r["score"] == 0 and r["train_tokens"] == 0 for r in none)


def test_probabilities_sum_to_one(spark):
    """Over the known words and the unknown one, in every state and at the root."""
    r = random.Random(1)
    texts = []
    for _ in range(400):
        t = ["a"]
        while len(t) < 30:
            t.append({"a": "b", "b": r.choice("cd"), "c": "a", "d": r.choice("ad")}[t[-1]])
        texts.append(" ".join([*t, f"rare{r.randrange(900)}"]))
    tree, _ = lm_scoring.train(docs_of(spark, texts).select("text"))
    assert len(tree.contexts[0][0]) >= 3 and len(tree.contexts) == 2
    states, weights = tree.contexts[0]
    for key, weight in zip(states, weights, strict=True):
        p = 10 ** tree.parent(1, [np.full(len(tree.words), key)], tree.common, np.arange(len(tree.words)))
        assert p.sum() + 10**weight * tree.v / (tree.n + tree.v) == pytest.approx(1, abs=1e-6)
    assert (10**tree.root).sum() + tree.v / (tree.n + tree.v) == pytest.approx(1)


def test_fingerprints(spark, docs):
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(both).collect()}
    order = sorted(((r["doc_id"], r["text"] or "") for r in both.collect()), reverse=True)
    sets = {}
    by_text = {}
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        assert by_text.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        for x in (t, changed):
            w = words(x)
            sets[x] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        a, b = sets[t], sets[changed]
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[i]["near_edited"] - true) < 0.25
    assert fingerprints.fingerprint_documents(both.limit(0)).count() == 0
    assert fingerprints.fingerprint_documents(both.limit(1)).count() == 1
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "x"), (3, "y z"), (3, "y z")], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(odd).count() == 4


def links(texts, n, percent):
    """Components by brute force over all pairs that share a shingle."""
    sets, inv = {}, collections.defaultdict(list)
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        for s in sets[i]:
            inv[s].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for k, common in collections.Counter(k for x in s for k in inv[x] if k < i).items():
            if 100 * common >= percent * (len(s) + len(sets[k]) - common):
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed):
    """Chains and stars of near copies, small sets, shared passages."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    shared = [word() for _ in range(40)]
    out = []
    for size in (6, 7, 9, 12, 20, 33, 60, 150, 400):
        base = [word() for _ in range(size)]
        now = list(base)
        for _ in range(12):
            out.append(" ".join(now))
            if r.random() < 0.5:
                now = list(base)
            k = r.randrange(len(now))
            now[k : k + r.choice([0, 1])] = [word()] * r.choice([0, 1])
        out.append(" ".join(shared + base[: size // 3]))
        out.append(" ".join(base[: size // 3] + shared))
    return out


def test_ngram_join(spark, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts += [(10_000 + i, t) for i, t in enumerate([*variants(1), *variants(2), *[t for t in ODD if t is None or len(t) < 1000]])]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    for n, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.group_documents(d, n, percent).collect()}
        assert got == links(texts, n, percent)
    odd = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.group_documents(odd).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert jaccard_join.group_documents(d.limit(0)).count() == 0


def test_light_and_heavy_agree(spark, monkeypatch):
    texts = list(enumerate(variants(3)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for x in (2, 30, 10_000):
        if x == 10_000:
            texts = [(i, t) for i, t in texts if len(t.split()) < 40]
            d = spark.createDataFrame(texts, "doc_id long, text string")
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_, x=x: x)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.group_documents(d).collect()}
        assert got == links(texts, 4, 85)


def test_near_duplicates(spark):
    texts = list(enumerate([t for t in variants(4) if len(t.split()) > 50]))
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    true = {i: c for i, (_, c) in links(texts, 5, 80).items()}
    assert sum(got[i] == true[i] for i in got) >= 0.95 * len(got)
    assert all(true[i] == true[got[i]] for i in got)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(100, i) for i in range(101, 160)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3)) and all(got[i] == 5 for i in range(5, 10)) and got[159] == 100 and got[240] == 200 and 20 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing", "sharding"]
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 34", "en", None, 5)], DOCS)
    now = docs.union(extra)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in stages.items():
        out = stage(spark, now, sf_dir)
        if name == "language ID":
            assert {r["doc_id"] for r in now.collect()} - {r["doc_id"] for r in out.collect()} == {90_001, 90_002}
        elif name == "n-gram Jaccard join":
            true = links([(r["doc_id"], r["text"]) for r in now.collect()], 5, 80)
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in true.items() if i == c}
        elif name == "benchmark decontamination":
            clean = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
            items = [clean(r["text"]) for r in bench.collect()]
            bad = {r["doc_id"] for r in now.collect() if any(b in clean(r["text"]) for b in items)}
            assert {r["doc_id"] for r in now.collect()} - {r["doc_id"] for r in out.collect()} == bad
        assert out.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
        before, now = now, spark.createDataFrame(out.collect(), out.schema)
    assert now.count() == before.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_fingerprints_with_classes(spark):
    texts = [(i, f"one two three four five six {i // 3}") for i in range(30)] + [(None, "x"), (4, "again and again and more")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    classes = spark.createDataFrame([(i, i - i % 3) for i in range(30)], "doc_id long, class_id long")
    rows = fingerprints.fingerprint_documents(d, classes).collect()
    assert len(rows) == 32 and all(r["class_id"] == (None if r["doc_id"] is None else r["doc_id"] - r["doc_id"] % 3) for r in rows)
