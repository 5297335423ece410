"""Behaviour of the dataset and evaluation operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import features, jsonx, prompts, scalars
from larkspan.functions.invariants import drop_invalid, require_valid, violations
from larkspan.functions.schema import CORRECTION, EXAMPLE, LABELS
from larkspan.operators import baseline, datasets, generation, hook, metrics, templates, validation
from larkspan.sources import dataset_io
from larkspan.sources.templates import checked, template_table
from larkspan.streaming import hook_stream


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pred array<string>, gold array<string>, pred_risk string, gold_risk string, is_hard_negative boolean")


def example(i, split="train", **more):
    return {"id": f"{split}-{i:05d}", "text": f"text {i}", "labels": ["LOCATION"], "risk": "MEDIUM", "rationale": "why", "is_hard_negative": False, "split": split, "domain": "medical", "source": "template"} | more


def examples(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in EXAMPLE.names) for r in rows], EXAMPLE)


def test_metrics_small_cases(spark):
    none = metrics.evaluation_report(pairs(spark, [([], [], "LOW", "LOW", False)]), "m").first()
    assert none["multilabel_f1"] == 0 and none["hard_negative_precision"] == 1 and none["false_negative_rate"] == 0
    one = metrics.evaluation_report(pairs(spark, [(["LOCATION"], ["LOCATION"], "LOW", "LOW", False)]), "m").first()
    assert one["multilabel_f1"] == pytest.approx(1 / 8) and one["f1_by_label"]["LOCATION"] == 1 and one["quasi_id_f1"] == 0
    risks = [([], [], p, g, False) for p, g in (("LOW", "LOW"), ("MEDIUM", "HIGH"), ("HIGH", "HIGH"), ("LOW", "LOW"))]
    assert metrics.evaluation_report(pairs(spark, risks), "m").first()["risk_accuracy"] == 0.75
    missed = [([], ["ROUTINE"], "LOW", "HIGH", False), (["ROUTINE"], [], "HIGH", "LOW", True), ([], [], "LOW", "LOW", True)]
    r = metrics.evaluation_report(pairs(spark, missed), "m").first()
    assert r["false_negative_rate"] == 1 and r["hard_negative_precision"] == 0.5
    assert metrics.label_f1(pairs(spark, missed)).count() == len(LABELS)
    assert metrics.evaluation_report(pairs(spark, []), "m").first()["risk_accuracy"] == 0


def test_compare_and_targets(spark):
    good = metrics.evaluation_report(pairs(spark, [([x], [x], "HIGH", "HIGH", False) for x in LABELS]), "a")
    bad = metrics.evaluation_report(pairs(spark, [([], [x], "LOW", "HIGH", False) for x in LABELS]), "b")
    rows = {r["metric"]: r for r in metrics.compare(good, bad).collect()}
    assert rows["multilabel_f1"]["delta"] == 1 and rows["false_negative_rate"]["delta"] == -1 and len(rows) == 13
    assert all(r["passed"] for r in metrics.check_targets(good).collect())
    assert sum(r["passed"] for r in metrics.check_targets(bad).collect()) == 1
    text = metrics.render_comparison(metrics.compare(good, bad), 8)
    assert "+1.0000" in text and text.count("F1 ") == 8


@pytest.mark.parametrize(
    ("raw", "labels", "risk", "rationale"),
    [
        ('{"labels":["LOCATION"],"risk":"HIGH","rationale":"x"}', ["LOCATION"], "HIGH", "x"),
        ('```json\n{"labels":["LOCATION"],"risk":"HIGH","rationale":"x"}\n```', ["LOCATION"], "HIGH", "x"),
        ('so: {"labels":["ROUTINE"],"risk":"MEDIUM","rationale":"y"} ok', ["ROUTINE"], "MEDIUM", "y"),
        ('{"labels":["ROUTINE",],"risk":"MEDIUM","rationale":"y",}', ["ROUTINE"], "MEDIUM", "y"),
        ("{'labels':['ROUTINE'],'risk':'MEDIUM','rationale':'y'}", ["ROUTINE"], "MEDIUM", "y"),
        ('{"labels":["ROUTINE"],"risk":"MEDIUM","rationale":"y"', ["ROUTINE"], "MEDIUM", "y"),
        ('{"labels":["ROUTINE","LOCATION","ROUTINE"],"risk":"HIGH","rationale":""}', ["LOCATION", "ROUTINE"], "HIGH", "Multiple quasi-identifiers detected."),
        ('{"labels":["NO",5],"risk":"HIGH","rationale":"z"}', [], "LOW", ""),
        ('{"labels":"LOCATION","risk":["HIGH"],"rationale":4}', [], "LOW", ""),
        ('{"labels":["LOCATION"],"risk":"LOW","rationale":"z"}', ["LOCATION"], "LOW", ""),
        ('{"labels":["A"', [], "LOW", ""),
        ("nothing", [], "LOW", ""),
        ("", [], "LOW", ""),
        (None, [], "LOW", ""),
        ("[1, 2]", [], "LOW", ""),
    ],
)
def test_parse_output(spark, raw, labels, risk, rationale):
    jsonx.configure(spark)
    r = spark.createDataFrame([(raw,)], "s string").select(jsonx.parse_output(F.col("s")).alias("p")).first()["p"]
    assert (r["labels"], r["risk"], r["rationale"]) == (labels, risk, rationale)


def test_fences_and_arrays(spark):
    d = spark.createDataFrame([("```json\n[1]\n```",), ("```\n[2]\n```",), ("a ```[3]```",), ("",)], "s string")
    assert [r[0] for r in d.select(jsonx.strip_code_fences(F.col("s"))).collect()] == ["[1]", "[2]", "a ```[3]```", ""]
    d = spark.createDataFrame([('{"z":[1],"a":[2]}',), ("[3]",), ('{"a":1}',), ("x",)], "s string")
    assert [r[0] for r in d.select(jsonx.first_array(F.col("s"))).collect()] == ["[1]", "[3]", None, None]


def test_invariants(spark):
    rows = [example(1), example(2, labels=[], risk="HIGH"), example(3, rationale=""), example(4, risk="LOW"), example(5, text=""), example(6, is_hard_negative=True), example(7, id="train-123456"), example(8, labels=["PHONE"]), example(9, text=" ")]
    d = examples(spark, rows)
    got = [r[0] for r in d.orderBy("id").select("id", violations().alias("v")).select(F.array_join("v", ",")).collect()]
    assert got == ["", "unlabelled_risk", "risk_rationale", "low_rationale", "text", "hard_negative", "labels", "", "id"]
    assert drop_invalid(d).count() == 2
    with pytest.raises(Exception, match="invalid example"):
        require_valid(d).collect()


def test_splits_ids_and_sample(spark):
    d = spark.range(1000).select("id", F.element_at(F.array(*[F.lit(x) for x in ("medical", "personal")]), (F.col("id") % 2 + 1).cast("int")).alias("domain"), F.lit("HIGH").alias("risk")).withColumnRenamed("id", "k")
    s = datasets.assign_splits(d, "k", 3)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 800, "validation": 100, "test": 100}
    ids = datasets.assign_ids(s, "k", 3, {"train": 5})
    assert ids.select("id").distinct().count() == 1000 and ids.agg(F.min("id")).first()[0] == "test-00001"
    assert ids.where("split = 'train'").agg(F.min("id"), F.max("id")).first()[:] == ("train-00006", "train-00805")
    assert sorted(ids.collect()) == sorted(datasets.assign_ids(datasets.assign_splits(d.repartition(7), "k", 3), "k", 3, {"train": 5}).collect())
    sample = datasets.review_sample(ids, 0.01, 1)
    assert {r["split"]: r["count"] for r in sample.groupBy("split").count().collect()} == {"train": 8, "validation": 1, "test": 1}


def test_hard_negatives(spark):
    d = examples(spark, [example(i) for i in range(1, 91)] + [example(i, "validation") for i in range(1, 10)] + [example(i, "test") for i in range(1, 10)])
    texts = spark.createDataFrame([(0, "a"), (1, " "), (2, "b"), (3, "c")], "n int, text string")
    new = datasets.inject_hard_negatives(d, texts, 0.1, "n").where("is_hard_negative")
    got = {r["split"]: r["n"] for r in new.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 10, "validation": 1, "test": 1}
    assert new.where("split = 'train'").agg(F.min("id"), F.max("id")).first()[:] == ("train-00091", "train-00100")
    assert [r["text"] for r in new.where("split = 'train'").orderBy("id").limit(4).collect()] == ["a", "b", "c", "a"]
    assert drop_invalid(new).count() == 12
    assert datasets.inject_hard_negatives(d, texts, 0.0, "n").count() == 108


def test_corrections(spark):
    d = examples(spark, [example(1), example(2), example(3, labels=[], risk="LOW", rationale="", is_hard_negative=True, source="hard-negative")])
    schema = T.StructType([*CORRECTION.fields, T.StructField("ord", T.IntegerType())])
    c = spark.createDataFrame(
        [("train-00001", ["ROUTINE"], "HIGH", "r", None, None, 1), ("train-00001", None, "MEDIUM", None, None, None, 2), ("train-00002", [], "HIGH", "r", None, None, 1), ("train-00003", ["ROUTINE"], "HIGH", "r", False, "template", 1), ("train-09999", None, "LOW", "", None, None, 1)],
        schema,
    )
    rows = {r["id"]: r for r in datasets.apply_corrections(d, c).collect()}
    assert rows["train-00001"]["risk"] == "MEDIUM" and rows["train-00001"]["labels"] == ["ROUTINE"] and rows["train-00001"]["violations"] == []
    assert rows["train-00002"]["violations"] == ["unlabelled_risk"]
    assert rows["train-00003"]["violations"] == [] and not rows["train-00003"]["is_hard_negative"] and len(rows) == 3
    assert [r["id"] for r in datasets.unknown_corrections(c, d).collect()] == ["train-09999"]
    assert datasets.apply_corrections(d, c.limit(0)).drop("violations").exceptAll(d).count() == 0


@pytest.mark.parametrize(
    ("entries", "kept"),
    [
        ([{"id": "train-00001", "labels": ["ROUTINE"], "risk": "HIGH", "rationale": "r"}, {"id": "zzz", "labels": []}], {"train-00001"}),
        ([{"id": "x", "labels": ["ROUTINE"]}, "junk", {"id": "y", "labels": ["ROUTINE"]}], {"train-00001", "train-00002"}),
        ([{"id": "x", "labels": ["ROUTINE"]}], set()),
        ([{"id": "train-00001", "labels": ["ROUTINE"], "valid": False}, {"id": "train-00002", "labels": ["ROUTINE"], "valid": None}], set()),
        ([{"id": "train-00001", "labels": ["ROUTINE"], "valid": "false"}, {"id": "train-00002"}], {"train-00001"}),
        ([{"id": "train-00001", "labels": ["PHONE"]}, {"id": "train-00002", "labels": ["ROUTINE"], "rationale": ""}], set()),
        ([{"id": "train-00001", "labels": None}, {"id": "train-00002", "labels": []}], set()),
    ],
)
def test_validation(spark, entries, kept):
    d = examples(spark, [example(1, source="llm-augmented"), example(2, source="llm-augmented")]).withColumns({"batch": F.lit(0), "place": F.when(F.col("id") == "train-00001", 0).otherwise(1)})
    r = spark.createDataFrame([(0, json.dumps(entries))], "batch int, response string")
    assert {x["id"] for x in validation.match(d, r).collect()} == kept


def test_prompts(spark):
    d = spark.createDataFrame([("w " * 2000, ["B", "A"], "LOW", ""), ("short {x}", ["B", "A"], "LOW", "")], "text string, labels array<string>, risk string, rationale string")
    assert prompts.training_text(d).select("text").first()[0] == "short {x}" and prompts.training_text(d).count() == 1
    t = prompts.training_text(d).first()["training_text"]
    assert t.endswith('<|assistant|>\n{"labels":["A","B"],"risk":"LOW","rationale":""}\n<|end|>') and "Text: short {x}\n" in t
    assert [len(r[0]) for r in d.select(prompts.assembled(F.col("text"))).collect()][0] == 1024
    p = d.select(prompts.generation_prompt(F.lit(3), F.lit("medical")), prompts.hard_negative_prompt(F.lit(2))).first()
    assert "medical" in p[0] and all(x in p[0] for x in LABELS) and "texts" in p[1]


def test_scalars(spark):
    d = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)], "n int")
    assert [r[0] for r in d.select(scalars.ordinal(F.col("n"))).collect()] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    one = spark.range(1)
    assert [one.select(scalars.half_even(F.lit(x))).first()[0] for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one.select(scalars.example_id(F.lit("train"), F.lit(123456))).first()[0] == "train-123456"
    assert [one.select(scalars.is_hub_id(F.lit(x))).first()[0] for x in ("a/b", "/a/b", "a/b/c", "a", "/a")] == [True, False, False, False, False]
    f = one.select(*[c.alias(n) for n, c in features.features(F.lit("Mail a.b@c.org! My password? 555-123-4567 at 12 Elm St")).items()]).first()
    assert f["has_email_pattern"] == f["has_phone_pattern"] == f["has_credential_pattern"] == f["has_address_pattern"] == 1 and f["ent_ORG"] == 0
    assert set(f.asDict()) == set(features.FEATURE_ORDER)
    assert one.select(features.sentence_count(F.lit("..."))).first()[0] == 1


def test_templates(spark, tmp_path):
    t = template_table(spark, [("b", {"domain": "medical", "patterns": [{"text": "{CITY} to {CITY}", "labels": ["LOCATION"], "risk": "HIGH", "rationale_template": "r"}]}), ("a", {"domain": "personal", "patterns": [{"text": "x", "labels": ["ROUTINE"], "risk": "LOW"}, {"text": "y", "labels": ["ROUTINE"], "risk": "LOW"}]})])
    rows = templates.generate(spark, t, 6, 1).orderBy("row").collect()
    assert [r["domain"] for r in rows] == ["personal", "medical"] * 3 and [r["text"] for r in rows[::2]] == ["x", "y", "x"]
    assert all("{" not in r["text"] for r in rows)
    for bad in ({}, {"domain": "zoo"}, {"domain": "medical"}, {"domain": "medical", "patterns": [{"text": "x", "risk": "LOW"}]}, {"domain": "medical", "patterns": [{"text": "x", "risk": "?", "labels": ["ROUTINE"]}]}, {"domain": "medical", "patterns": [{"text": "x", "risk": "LOW", "labels": ["?"]}]}):
        with pytest.raises(ValueError):
            checked(bad, "f")
    with pytest.raises(ValueError):
        templates.generate(spark, t, 0, 1)
    with pytest.raises(Exception, match="unknown slot"):
        spark.range(1).select(templates.fill(F.lit("{NOPE}"), 1, F.col("id"))).collect()


def test_dataset_io(spark, tmp_path):
    d = examples(spark, [example(1, labels=["ROUTINE", "LOCATION"]), example(1, "validation"), example(1, "test")])
    dataset_io.write_dataset(d, str(tmp_path / "d"))
    back = dataset_io.read_dataset(spark, str(tmp_path / "d"))
    assert back.count() == 3 and back.where("id = 'train-00001'").first()["labels"] == ["LOCATION", "ROUTINE"]
    dataset_io.append_dataset(examples(spark, [example(2)]), str(tmp_path / "d"))
    assert dataset_io.read_dataset(spark, str(tmp_path / "d")).count() == 4
    assert dataset_io.read_dataset(spark, str(tmp_path / "d"), ("test",)).count() == 1
    with pytest.raises(ValueError):
        dataset_io.read_dataset(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        dataset_io.write_dataset(d.limit(0), str(tmp_path / "e"))


def test_hook_and_stream(spark, tmp_path):
    rows = [("user_prompt", '{"query":"my password"}', 2), ("user_prompt", '{"query":"hello"}', 0), ("user_prompt", '{"query":5}', 0), ("pre_tool_use", '{"tool_input":{"token":1}}', 2), ("pre_tool_use", "{}", 0), ("post_tool_use", '{"tool_output":"api_key"}', 2), ("other", '{"query":"password"}', 0), ("user_prompt", "{bad", 1)]
    d = spark.createDataFrame([(h, p) for h, p, _ in rows], hook_stream.EVENT)
    out = {(r["hook_type"], r["payload"]): r for r in hook.scan(d).collect()}
    assert [out[h, p]["exit_code"] for h, p, _ in rows] == [c for _, _, c in rows]
    assert json.loads(out[rows[0][:2]]["message"])["labels"] == ["CREDENTIAL"] and out[rows[1][:2]]["message"] == ""
    d.write.json(str(tmp_path / "in"))
    q = hook_stream.scan_stream(hook_stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r["exit_code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(c for *_, c in rows)


def test_generation(spark, tmp_path):
    import yaml

    (tmp_path / "t").mkdir()
    for d in ("medical", "personal"):
        (tmp_path / "t" / f"{d}.yaml").write_text(yaml.safe_dump({"domain": d, "patterns": [{"text": "at {CITY}", "labels": ["LOCATION"], "risk": "HIGH", "rationale_template": "place"}]}))

    def writer(prompt):
        return json.dumps({"examples": [{"text": f"invented {i} {len(prompt)}", "labels": ["ROUTINE"], "risk": "MEDIUM", "rationale": "r", "domain": "medical"} for i in range(10)] + ["junk"]})

    def checker(prompt):
        batch = json.loads(prompt[prompt.index("Examples:\n") + 10 : prompt.index("\nAnswer")])
        return json.dumps({"results": [{"id": e["id"], "labels": e["labels"], "risk": e["risk"], "rationale": "checked"} for e in batch]})

    def negatives(prompt):
        return "```json\n" + json.dumps({"texts": ["Rome was not built in a day.", ""]}) + "\n```"

    config = generation.GenerationConfig(str(tmp_path / "t"), str(tmp_path / "out"), total_count=40, seed=1, batch=10)
    stats = {r["split"]: r for r in generation.generate_dataset(spark, config, writer, checker, negatives).collect()}
    assert sum(r["n"] - r["hard_negatives"] for r in stats.values()) == 36 and sum(r["hard_negatives"] for r in stats.values()) >= 3
    data = dataset_io.read_dataset(spark, config.output_dir)
    assert data.where("source = 'llm-augmented'").select("rationale").distinct().collect()[0][0] == "checked"
    again = generation.generate_dataset(spark, config, writer, checker, negatives)
    assert sum(r["n"] for r in again.collect()) == sum(r["n"] for r in stats.values())
    for bad in ({"total_count": 0}, {"template_fraction": 1.0}, {"hard_negative_ratio": 1.0}):
        with pytest.raises(ValueError):
            generation.GenerationConfig("a", "b", **bad)


def test_baseline(spark, tmp_path):
    rows = [(i, "my password is at home" if i % 2 else "plain words here", ["CREDENTIAL"] if i % 2 else [], "HIGH" if i % 2 else "LOW") for i in range(20)]
    d = spark.createDataFrame(rows, "k int, text string, labels array<string>, risk string")
    model = baseline.train(d, "k", trees=2, depth=2, max_features=20)
    assert isinstance(model.labels["ROUTINE"], float)
    baseline.save(model, str(tmp_path / "m"))
    for m in (model, baseline.load(str(tmp_path / "m"))):
        out = {r["k"]: r for r in m.predict(d, "k").collect()}
        assert all(out[i]["labels"] == ls and out[i]["risk"] == r for i, _, ls, r in rows)
        assert out[1]["rationale"] == "PII type detected: CREDENTIAL" and out[0]["rationale"] == ""
