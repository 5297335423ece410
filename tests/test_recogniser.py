"""The recogniser: best sequences against all sequences, shards, held-out templates, and counts as features."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions.features import ENTITIES, features
from larkspan.operators import recogniser, templates
from larkspan.sources.templates import shipped_templates


def test_best_sequence():
    r = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores, moves = r.integers(-5, 6, (n, 3)).astype(float), r.integers(-5, 6, (4, 3)).astype(float)
        value = lambda tags: sum(scores[i, t] + moves[tags[i - 1] if i else 3, t] for i, t in enumerate(tags))  # noqa: B023, E731
        assert value(recogniser.best(scores, moves).tolist()) == max(map(value, itertools.product(range(3), repeat=n)))


def test_pieces_join_to_the_filled_text(spark):
    rows = spark.range(44).select(F.col("id").alias("row")).join(F.broadcast(shipped_templates(spark).limit(9)))
    both = rows.select(templates.fill(F.col("text_template"), 5, F.col("row")).alias("a"), templates.traced(F.col("text_template"), 5, F.col("row")).alias("p")).collect()
    assert all(r["a"] == "".join(p["text"] for p in r["p"]) for r in both) and any(p["slot"] == "CITY" for r in both for p in r["p"])


@pytest.fixture(scope="module")
def trained(spark):
    table = shipped_templates(spark).withColumn("held", F.xxhash64("text_template") % 5 == 0)
    split = {h: recogniser.examples(spark.range(0 if not h else 10_000, 1200 if not h else 10_300).select(F.col("id").alias("row")), table.where("held" if h else "NOT held"), 7) for h in (False, True)}
    return recogniser.train(split[False], epochs=4), split


def test_held_out_templates(spark, trained):
    model, split = trained
    scores = {r["kind"]: r for r in recogniser.span_scores(model, split[True]).collect()}
    tp, wrong = sum(r["tp"] for r in scores.values()), sum(r["fp"] + r["fn"] for r in scores.values())
    f1 = tp / (tp + wrong / 2)
    print("held-out span F1", round(f1, 3), {k: round(r["f1"] or 0, 3) for k, r in scores.items()})
    # measured: 0.774; places are the weak kind
    assert f1 > 0.75
    own = recogniser.span_scores(model, split[False]).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    assert own[0] / (own[0] + (own[1] + own[2]) / 2) > 0.97


def test_shards_mix(spark, trained, monkeypatch):
    """Several shards learn too, and the same each time."""
    _, split = trained
    monkeypatch.setattr(recogniser, "SHARD", 300)
    a, b = (recogniser.train(split[False], epochs=2) for _ in range(2))
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()
    own = recogniser.span_scores(a, split[False]).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    assert own[0] / (own[0] + (own[1] + own[2]) / 2) > 0.9


def test_counts_as_features(spark, trained):
    model, _ = trained
    texts = ["Ines drives to Brindale every Monday.", "", None, "nothing here", "x" * 20_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("spans", model.found(spark)("text"))
    got = {r["i"]: r for r in d.select("i", *[c.alias(n) for n, c in features(F.col("text"), recogniser.entity_counts(F.col("spans"))).items()]).collect()}
    assert got[0]["ent_GPE"] >= 1 and got[0]["ent_DATE"] >= 1
    assert all(got[i][f"ent_{e}"] == 0 for i in (1, 2) for e in ENTITIES)
    assert model.spans("") == []


def test_sentences_read_together(monkeypatch):
    """Many sentences at once have the tags that each has alone, and take far fewer steps than they have tokens."""
    r = np.random.default_rng(3)
    model = recogniser.Recogniser(r.integers(-3, 4, (recogniser.PLACES, 5)) / 6, r.integers(-3, 4, (6, 5)) / 6)
    texts = ["Ines drives to Brindale. Every Monday!", "", None, "x", "Émile \ud800 İst 9-1", *[" ".join(r.choice(["Anna", "goes", "to", "Rome", ".", "on", "Monday"], 60)) for _ in range(50)]]
    lengths = [len(t) for text in texts for t in recogniser.sentences(text or "")]
    scores = r.integers(-5, 6, (sum(lengths), 5)) / 3
    alone = [recogniser.best(s, model.moves).tolist() for s in np.split(scores, np.cumsum(lengths)[:-1])]
    assert [t.tolist() for t in recogniser.best_of(scores, np.array(lengths), model.moves)] == alone
    one = [model.spans(t) for t in texts]
    monkeypatch.setattr(recogniser, "TOKENS", 40)
    assert model.spans_of(texts) == one and sum(map(len, one)) > 100
    steps = []
    monkeypatch.setattr(recogniser, "best", lambda *a: steps.append(a))
    model.spans_of(texts)
    assert steps == []
