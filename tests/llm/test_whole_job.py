"""What operators once cut off: small cases in which that shows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspan.llm import decontam, lm_scoring, mixing, pii, sharding

TEXTS = "doc_id long, text string"


def brute_scores(texts, order, gain=lm_scoring.GAIN, floor=2, d=lm_scoring.DISCOUNT):
    """Scores by the definition, for all contexts and continuations of the training texts."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    streams = {i: ["<s>", *t.split(), "</s>"] for i, t in texts}
    counts, grams = collections.Counter(), collections.Counter()
    for i, t in streams.items():
        if not held(i):
            counts.update(t[1:])
            grams.update(tuple(t[at - k : at + 1]) for at in range(1, len(t)) for k in range(1, min(order, at) + 1))
    n, v = sum(counts.values()), len(counts)
    occurs = collections.Counter()
    for g, c in grams.items():
        occurs[g[:-1]] += c
    states = {}

    def lp(context, w):
        if not context:
            return math.log((counts[w] + 1) * n / (n + v) ** 2 if counts[w] else v / (n + v))
        if context not in states:
            return lp(context[1:], w)
        weight, own = states[context]
        return own[w] if w in own else math.log(weight) + lp(context[1:], w)

    for k in range(1, order + 1):
        by = collections.defaultdict(dict)
        for g, c in grams.items():
            if len(g) == k + 1 and c >= floor:
                by[g[:-1]][g[-1]] = c
        new = {}
        for context, follow in by.items():
            total = occurs[context]
            weight = max(1e-12, 1 - sum(c - d for c in follow.values()) / total)
            own = {w: math.log((c - d) / total + weight * math.exp(lp(context[1:], w))) for w, c in follow.items()}
            more = sum(c * (own[w] - lp(context[1:], w)) for w, c in follow.items()) + (total - sum(follow.values())) * math.log(weight)
            if more > gain * len(follow):
                new[context] = (weight, own)
        states |= new
    return {i: sum(lp(tuple(t[max(0, at - order) : at]), t[at]) for at in range(1, len(t))) / math.log(10) for i, t in streams.items()}


@pytest.mark.parametrize("order,share", [(2, None), (2, 0.01), (3, 0.01)])
def test_rare_phrases_are_learned(spark, monkeypatch, order, share):
    """Phrases seen twice in 60,000 tokens; share moves nearly everything out of what is broadcast."""
    r = random.Random(5)
    texts = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(200))) for i in range(300)]
    train = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    out = next(i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2)
    for i in (*train[:2], out):
        texts[i] = (i, f"{texts[i][1]} once upon a distant midnight dreary")
    if share:
        monkeypatch.setattr(lm_scoring, "FREQUENT", share)
        monkeypatch.setattr(lm_scoring, "HEAD", share)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.createDataFrame(texts, TEXTS), order=order).collect()}
    assert got == pytest.approx(brute_scores(texts, order), abs=1e-6)


def test_terms_far_from_a_value_and_of_rare_values(spark):
    far = "some plain words here " * 60
    texts = [f"zorblatt began it. {far} write to jo@corp.example {far} zorblatt ended it" for _ in range(3)]
    texts += [f"only here quuxly met al@corp.example {far}"] + [f"{far} and more of it {i % 3}" for i in range(300)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), TEXTS)).collect()}
    for i in range(3):
        assert clean[i] == texts[i].replace("zorblatt", "").replace("began", "").replace("ended", "").replace("write", "").replace("to jo@corp.example", " [EMAIL]")
    assert "quuxly" not in clean[3] and far in clean[3]
    assert all(clean[i] == texts[i] for i in range(4, len(texts)))


def test_pipeline_shards_follow_the_curriculum(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs)
    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    order = [r["doc_id"] for r in mixed.collect()]
    for rows in (spark.read.parquet(path), spark.createDataFrame(mixed.collect(), mixed.schema)):
        out = dict(corpus_pipeline.STAGES)["sharding"](spark, rows, sf_dir)
        got = out.select("shard", "slot", "doc_id", "text").collect()
        assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == order
        sizes = collections.Counter()
        for r in got:
            sizes[r["shard"]] += len((r["text"] or "").encode()) + sharding.OVERHEAD
        assert set(sizes) == set(range(24)) and all(min(r["slot"] for r in got if r["shard"] == k) == 0 for k in sizes)


@pytest.mark.parametrize("few", [True, False])
def test_short_items_with_substitutions(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    items = [[f"i{n}k{k}" for k in range(n)] for n in range(4, 10)]
    r = random.Random(3)
    docs, expected = [], set()
    for n, item in zip(range(4, 10), items, strict=True):
        for changed in range(n):
            for _ in range(3):
                at = set(r.sample(range(n), changed))
                if 5 * (n - changed) >= 3 * n:
                    expected.add((len(docs), n))
                docs.append(" ".join(["before", "it", *("other" if k in at else w for k, w in enumerate(item)), "after"]))
    bench = spark.createDataFrame([(len(t), " ".join(t)) for t in items], "item_id long, text string")
    got = decontam.find_contamination(spark.createDataFrame(list(enumerate(docs)), TEXTS), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == expected and all(x["doc_start"] == 2 for x in got)
