"""The generator's journal, retries and quotas, the dataset's commits, and boosting, on small cases."""

import collections
import json
import math
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larkspan.functions.quotas import apportion, first_of
from larkspan.functions.schema import DOMAINS, EXAMPLE
from larkspan.operators import datasets, generation
from larkspan.sources import answers, dataset_io, model_client
from larkspan.sources.journal import Journal

# clients run in processes that don't have this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def note(folder, kind):
    """One more call of a kind; calls happen in other processes."""
    (folder / f"{kind}-{os.urandom(8).hex()}").write_text("")


def calls(folder, kind):
    return sum(f.name.startswith(f"{kind}-") for f in folder.iterdir())


@pytest.fixture
def made(tmp_path):
    import yaml

    for d in ("t", "calls"):
        (tmp_path / d).mkdir()
    for d in ("medical", "personal"):
        (tmp_path / "t" / f"{d}.yaml").write_text(yaml.safe_dump({"domain": d, "patterns": [{"text": "at {CITY}", "labels": ["LOCATION"], "risk": "HIGH", "rationale_template": "place"}]}))
    return tmp_path


def writer_of(folder, many=10):
    def writer(prompt):
        note(folder, "write")
        return json.dumps({"examples": [{"text": f"invented {i} {os.urandom(4).hex()}", "labels": ["ROUTINE"], "risk": "MEDIUM", "rationale": "r", "domain": "medical"} for i in range(many)]})

    return writer


def checker_of(folder, fails=0, lost=0):
    """Fails the first calls, and leaves out examples of the first answer."""

    def checker(prompt):
        note(folder, "check")
        n = calls(folder, "check")
        if n <= fails:
            raise OSError("no connection")
        batch = json.loads(prompt[prompt.index("Examples:\n") + 10 : prompt.index("\nAnswer")])
        if n == fails + 1:
            batch = batch[lost:]
        return json.dumps({"results": [{"id": e["id"], "labels": e["labels"], "risk": e["risk"], "rationale": "checked"} for e in batch]})

    return checker


def config_of(made, **more):
    return generation.GenerationConfig(**({"templates_dir": str(made / "t"), "output_dir": str(made / "out"), "total_count": 40, "hard_negative_ratio": 0.0, "seed": 1, "batch": 50} | more))


def test_a_lost_batch_is_asked_again(spark, made):
    folder = made / "calls"
    stats = generation.generate_dataset(spark, config_of(made), writer_of(folder), checker_of(folder, fails=2)).collect()
    assert sum(r["n"] for r in stats) == 40
    assert dataset_io.read_dataset(spark, str(made / "out")).where("source = 'llm-augmented'").select("rationale").distinct().collect()[0][0] == "checked"
    assert not os.listdir(made / "out-journal") and calls(folder, "check") == 3


def test_losses_are_made_up_for(spark, made):
    folder = made / "calls"
    stats = generation.generate_dataset(spark, config_of(made), writer_of(folder), checker_of(folder, lost=4)).collect()
    assert sum(r["n"] for r in stats) == 40
    ids = [r["id"] for r in dataset_io.read_dataset(spark, str(made / "out")).select("id").collect()]
    assert len(set(ids)) == 40


def test_a_checker_that_never_answers_aborts(spark, made):
    folder = made / "calls"
    with pytest.raises(RuntimeError, match="5 passes in a row"):
        generation.generate_dataset(spark, config_of(made), writer_of(folder), checker_of(folder, fails=1000))
    written = calls(folder, "write")
    # what was made stays, and the writer isn't asked again
    stats = generation.generate_dataset(spark, config_of(made), writer_of(folder), checker_of(folder)).collect()
    assert sum(r["n"] for r in stats) == 40 and calls(folder, "write") == written


def test_too_few_after_all_rounds_raises(spark, made):
    def refuses(prompt):
        return json.dumps({"results": []})

    folder = made / "calls"
    with pytest.raises(RuntimeError, match="3 rounds made"):
        generation.generate_dataset(spark, config_of(made), writer_of(folder), refuses)
    assert not (made / "out").exists()


def test_a_restart_goes_on(spark, made, monkeypatch):
    """Ends between a round's table and the commit of the dataset; the second run asks nobody and comes to the same rows."""
    folder = made / "calls"
    write = dataset_io.write_dataset

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(dataset_io, "write_dataset", killed)
    with pytest.raises(KeyboardInterrupt):
        generation.generate_dataset(spark, config_of(made), writer_of(folder), checker_of(folder))
    before = len(list(folder.iterdir()))
    (run,) = os.listdir(made / "out-journal")
    checked = {r["id"]: r["text"] for r in Journal(spark, str(made / "out-journal" / run)).table("0-checked", lambda: pytest.fail("made again")).collect()}
    monkeypatch.setattr(dataset_io, "write_dataset", write)
    generation.generate_dataset(spark, config_of(made), writer_of(folder), checker_of(folder))
    assert len(list(folder.iterdir())) == before
    assert {r["id"]: r["text"] for r in dataset_io.read_dataset(spark, str(made / "out")).collect()} == checked


def test_hard_negatives_in_batches(spark, made):
    folder, sizes = made / "calls", []

    def negatives(prompt):
        note(folder, f"negatives_{prompt.split()[1]}")
        return json.dumps({"texts": [f"Rome was not built in {os.urandom(3).hex()} days.", " \n\t", ""] * 20})

    config = config_of(made, total_count=700, hard_negative_ratio=0.3, model="qwen2.5:3b")
    stats = generation.generate_dataset(spark, config, None, None, negatives).collect()
    assert sum(r["hard_negatives"] for r in stats) == sum(round((r["n"] - r["hard_negatives"]) * 0.3 / 0.7) for r in stats)
    sizes = {int(f.name.split("-")[0].split("_")[1]) for f in folder.iterdir()}
    assert max(sizes) == 80 and len(list(folder.iterdir())) > 3
    assert dataset_io.read_dataset(spark, str(made / "out")).where("is_hard_negative AND trim(text) = ''").isEmpty()


def test_domains_share_the_examples(spark, made):
    folder = made / "calls"

    def uneven(prompt):
        """Half of what is asked for in one domain, nothing in another."""
        note(folder, "write")
        domain = next(d for d in DOMAINS if f'"{d}"' in prompt)
        n = int(prompt.split()[1])
        n = {"medical": n // 2, "personal": 0}.get(domain, n)
        return json.dumps({"examples": [{"text": f"{domain} {os.urandom(6).hex()}", "labels": ["ROUTINE"], "risk": "MEDIUM", "rationale": "r", "domain": domain} for _ in range(n)]})

    journal = Journal(spark, str(made / "j"))
    rows = generation.from_model(spark, 200, uneven, journal, "m", 42)
    got = collections.Counter(r["domain"] for r in rows.collect())
    assert sum(got.values()) == 200 and set(got) == {"medical", "scheduling", "workplace"} and got["scheduling"] >= 50
    assert sorted(r["text"] for r in rows.collect()) == sorted(r["text"] for r in generation.from_model(spark, 200, uneven, journal, "m", 42).collect())
    with pytest.raises(RuntimeError, match="no example"):
        generation.from_model(spark, 5, lambda prompt: "", journal, "none", 42)


def test_answers_are_kept(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def client(prompt):
        note(tmp_path / "calls", prompt)
        if calls(tmp_path / "calls", prompt) <= int(prompt):
            raise OSError("busy")
        return {"0": '["a"]', "1": '{"x": ["b"]}', "2": "```json\n[1]\n```"}[prompt]

    prompts = spark.createDataFrame([(str(i), str(i)) for i in range(3)], "call string, prompt string")
    journal = Journal(spark, str(tmp_path / "j"))
    got = {r["call"]: json.loads(r["response"]) for r in answers.answered(prompts, client, journal, "x").collect()}
    assert got == {"0": ["a"], "1": ["b"], "2": [1]}
    assert [calls(tmp_path / "calls", str(i)) for i in range(3)] == [1, 2, 3]
    answers.answered(prompts, client, journal, "x").collect()
    assert len(list((tmp_path / "calls").iterdir())) == 6
    assert model_client.ask(prompts, lambda p: "{}", 1).where("response IS NULL").count() == 3
    assert answers.answered(prompts.limit(0), client, journal, "y").collect() == []


def brute_quotas(groups, total):
    open_, quota, left = dict(groups), {}, min(total, sum(c for _, c in groups.values()))
    while True:
        weights = sum(w for w, _ in open_.values())
        full = {g for g, (w, c) in open_.items() if left * w >= c * weights}
        if not full:
            break
        for g in full:
            quota[g] = open_.pop(g)[1]
            left -= quota[g]
    weights = sum(w for w, _ in open_.values())
    parts = {g: divmod(left * w, weights) for g, (w, _) in open_.items()}
    rest = left - sum(p[0] for p in parts.values())
    for i, g in enumerate(sorted(parts, key=lambda g: (-parts[g][1], g))):
        quota[g] = parts[g][0] + (i < rest)
    return quota


@pytest.mark.parametrize("total", [0, 1, 7, 100, 997, 5000])
def test_quotas(spark, total):
    r = np.random.default_rng(total)
    groups = {f"g{i}": (int(r.integers(1, 9)), int(r.integers(0, 300))) for i in range(12)}
    rows = spark.createDataFrame([(g, w, c) for g, (w, c) in groups.items()], "group string, weight bigint, cap bigint")
    got = {r["group"]: r["quota"] for r in apportion(rows, total).collect()}
    assert got == brute_quotas(groups, total) and sum(got.values()) == min(total, sum(c for _, c in groups.values()))


def test_first_of_groups(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    quotas = spark.createDataFrame([("a", 7), ("b", 200), ("c", 3)], "group string, quota bigint")
    got = collections.defaultdict(list)
    for r in first_of(rows, "g", "h", ["id"], quotas).collect():
        got[r["g"]].append((r["h"], r["position"]))
    everything = collections.defaultdict(list)
    for r in rows.collect():
        everything[r["g"]].append(r["h"])
    assert {g: sorted(v) for g, v in got.items()} == {g: [(h, i + 1) for i, h in enumerate(sorted(everything[g])[: {"a": 7, "b": 200}[g]])] for g in "ab"}


def example(i, split="train", text=None):
    return (f"{split}-{i:05d}", text or f"text {i}", ["ROUTINE"], "HIGH", "why", False, split, "personal", "template")


def test_a_failing_write_leaves_the_dataset(spark, tmp_path):
    path = str(tmp_path / "d")
    old = spark.createDataFrame([example(1), example(1, "validation"), example(1, "test")], EXAMPLE)
    dataset_io.write_dataset(old, path)
    new = spark.createDataFrame([example(2), example(2, "validation"), example(2, "test")], EXAMPLE)
    bad = new.withColumn("text", F.when(F.col("split") == "test", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    for write in (dataset_io.write_dataset, dataset_io.append_dataset):
        with pytest.raises(Exception, match="broken"):
            write(bad, path)
        assert sorted(r["id"] for r in dataset_io.read_dataset(spark, path).collect()) == ["test-00001", "train-00001", "validation-00001"]
        assert not [n for n in os.listdir(path) if n.startswith("_staged")]
    dataset_io.append_dataset(new, path)
    assert dataset_io.read_dataset(spark, path).count() == 6
    dataset_io.write_dataset(new.where("split = 'train'"), path)
    assert [r["id"] for r in dataset_io.read_dataset(spark, path).collect()] == ["train-00002"]
    assert dataset_io.read_dataset(spark, path, ("test",)).count() == 0
    with pytest.raises(ValueError, match="empty"):
        dataset_io.write_dataset(new.limit(0), path)
    assert dataset_io.read_dataset(spark, path).count() == 1


def test_a_move_that_stops_half_way_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    dataset_io.write_dataset(spark.createDataFrame([example(1)], EXAMPLE), path)
    monkeypatch.setattr(dataset_io, "put", lambda *_: False)
    with pytest.raises(RuntimeError, match="meanwhile"):
        dataset_io.append_dataset(spark.createDataFrame([example(2)], EXAMPLE), path)
    assert [r["id"] for r in dataset_io.read_dataset(spark, path).collect()] == ["train-00001"]


@pytest.mark.parametrize("file", [True, False])
def test_datasets_of_others(spark, tmp_path, file):
    """Plain files and folders of JSON lines, blank lines among them, are read and appended to."""
    lines = "".join(json.dumps(dict(zip(EXAMPLE.names, example(i), strict=True))) + "\n\n" for i in (1, 2))
    path = tmp_path / "d"
    path.mkdir()
    target = path / "train.jsonl"
    if not file:
        target.mkdir()
        target = target / "part-0.json"
    target.write_text(lines)
    assert dataset_io.read_dataset(spark, str(path)).count() == 2
    dataset_io.append_dataset(spark.createDataFrame([example(3), example(1, "test")], EXAMPLE), str(path))
    assert sorted(r["id"] for r in dataset_io.read_dataset(spark, str(path)).collect()) == ["test-00001", "train-00001", "train-00002", "train-00003"]


def test_split_sizes_and_ids_of_a_dataset(spark, made):
    generation.generate_dataset(spark, config_of(made, total_count=50))
    data = dataset_io.read_dataset(spark, str(made / "out"))
    stats = {r["split"]: r for r in datasets.dataset_stats(data).collect()}
    assert sum(r["n"] for r in stats.values()) == 50 and all(r["max_id"] == r["n"] for r in stats.values())
    assert math.isclose(stats["train"]["n"], 40, abs_tol=2)
