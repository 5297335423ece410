"""Training tables, subword tokenizers and detectors."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larkspan import Detector, scan_with
from larkspan.functions import prompts
from larkspan.functions.schema import EXAMPLE
from larkspan.functions.subwords import subwords
from larkspan.operators import baseline, training
from larkspan.sources import dataset_io
from larkspan.streaming import hook_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def dataset_of(spark, folder, texts):
    rows = [(f"train-{i:05d}", t, ["ROUTINE"], "HIGH", "why", False, "train", "personal", "template") for i, t in enumerate(texts)]
    rows.append(("test-00001", "held out", [], "LOW", "", False, "test", "personal", "template"))
    dataset_io.write_dataset(spark.createDataFrame(rows, EXAMPLE), folder)


def test_training_table(spark, tmp_path):
    dataset_of(spark, str(tmp_path / "d"), [f"text {i}" if i % 10 else "long " * 2000 for i in range(200)])
    rows, counts = training.prepare_dataset(spark, str(tmp_path / "d"), str(tmp_path / "t"), seed=5)
    assert counts == {"kept": 180, "skipped": 20} and rows.count() == 180
    # the order is in the files: a global one, that of another seed is another
    order = [r["id"] for r in rows.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index")).collect()]
    made = rows.select("id", F.md5(F.concat(F.lit("5:"), "id").cast("binary")).alias("h")).orderBy("h").collect()
    assert order == [r["id"] for r in made] != sorted(order)
    again, _ = training.prepare_dataset(spark, str(tmp_path / "d"), str(tmp_path / "u"), seed=6)
    assert [r["id"] for r in again.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index")).collect()] != order
    first = rows.where("id = 'train-00001'").first()["text"]
    assert first == prompts.BEFORE + "text 1" + prompts.AFTER + '{"labels":["ROUTINE"],"risk":"HIGH","rationale":"why"}' + prompts.COMPLETION_END


def test_nothing_fits(spark, tmp_path):
    dataset_of(spark, str(tmp_path / "d"), ["long " * 2000] * 3)
    rows, counts = training.prepare_dataset(spark, str(tmp_path / "d"), str(tmp_path / "t"))
    assert rows.count() == 0 and counts == {"kept": 0, "skipped": 3}


def test_subwords(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    texts = ["", "plain words", "two  blanks\n\ttab", "Grüße, 東京 \U0001f600", "<|endoftext|> inside", "x" * 5000, None]
    encode, decode = subwords(spark, VOCABULARY)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r["i"]: r for r in d.select("i", encode("t").alias("ids"), decode(encode("t")).alias("back")).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == own.encode(t or "", add_special_tokens=False).ids and got[i]["back"] == (t or "")
    # a long text gives way to the frame, and the whole stays within the limit
    frame = own.encode(prompts.BEFORE + prompts.AFTER, add_special_tokens=False).ids
    cut = spark.createDataFrame([("word " * 3000,), ("short",)], "t string").select(prompts.assembled(F.col("t"), encode, decode, 100).alias("p"), decode(prompts.assembled(F.col("t"), encode, decode, 100)).alias("s")).collect()
    assert 90 < len(cut[0]["p"]) <= 100 and len(cut[1]["p"]) < 100 and len(frame) < 100
    assert cut[1]["s"] == prompts.BEFORE + "short" + prompts.AFTER
    # the training table by subwords
    dataset_of(spark, str(tmp_path / "d"), ["ab " * 600, "zq" * 900, "fine"])
    rows, counts = training.prepare_dataset(spark, str(tmp_path / "d"), str(tmp_path / "t"), tokenize=encode)
    assert counts["kept"] + counts["skipped"] == 3 and all(r["n_tokens"] == len(own.encode(r["text"], add_special_tokens=False).ids) for r in rows.collect())
    assert counts["skipped"] >= 1


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rows = [(i, "my password is at home" if i % 2 else "plain words here", ["CREDENTIAL"] if i % 2 else [], "HIGH" if i % 2 else "LOW") for i in range(40)]
    d = spark.createDataFrame(rows, "k int, text string, labels array<string>, risk string")
    path = str(tmp_path_factory.mktemp("m") / "model")
    baseline.save(baseline.train(d, "k", trees=3, depth=2), path)
    return path


def test_detector(spark, saved, tmp_path):
    detector = Detector.from_pretrained(spark, saved)
    one = detector.predict("my password is at home")
    assert one.labels == {"CREDENTIAL"} and one.risk == "HIGH" and one.rationale == "PII type detected: CREDENTIAL"
    assert detector.predict("plain words here").labels == frozenset()
    with pytest.raises(ValueError, match="empty"):
        detector.predict("")
    with pytest.raises(FileNotFoundError):
        Detector.from_pretrained(spark, str(tmp_path / "none" / "of" / "it"))
    with pytest.raises(ValueError, match="hub"):
        Detector.from_pretrained(spark, "someone/model")
    # names of columns that prediction uses itself, null and empty texts, repeated rows
    rows = [(1, "my password is at home", "x", "keep"), (1, "my password is at home", "x", "keep"), (2, None, "x", "keep"), (3, "", "x", "keep")]
    d = spark.createDataFrame(rows, "k int, text string, Labels string, counts string").withColumn("features", F.lit(1)).withColumn("odd name", F.struct(F.lit(1).alias("a b")))
    got = sorted((r["k"], tuple(r["labels"]), r["risk"], r["counts"], r["odd name"]["a b"]) for r in detector.detect(d).collect())
    assert got == [(1, ("CREDENTIAL",), "HIGH", "keep", 1)] * 2 + [(2, (), "LOW", "keep", 1), (3, (), "LOW", "keep", 1)]


def test_scan_with_a_detector(spark, saved):
    rows = [("user_prompt", '{"query":"my password is at home"}', 2), ("user_prompt", '{"query":"plain words here"}', 0), ("pre_tool_use", "{}", 0), ("user_prompt", "{bad", 1)]
    d = spark.createDataFrame([(h, p) for h, p, _ in rows], hook_stream.EVENT)
    out = {(r["hook_type"], r["payload"]): r for r in scan_with(d, Detector.from_pretrained(spark, saved)).collect()}
    assert [out[h, p]["exit_code"] for h, p, _ in rows] == [c for *_, c in rows]
    assert json.loads(out[rows[0][:2]]["message"]) == {"labels": ["CREDENTIAL"], "risk": "HIGH", "rationale": "PII type detected: CREDENTIAL"}


def test_a_tokenizer_has_little_at_once(spark, monkeypatch):
    """However many rows a batch has, a tokenizer gets slices of bounded size."""
    import pyarrow as pa

    from larkspan.functions import subwords as module

    monkeypatch.setattr(module, "SLICE", 100)
    texts = ["short", None, "word " * 50, "", *["some more words"] * 40]
    parts = list(module.slices(pa.array(texts), pa.array([len(t or "") for t in texts])))
    assert [t for p in parts for t in p.to_pylist()] == texts and all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 100 for p in parts) and len(parts) < 12
    assert list(module.slices(pa.array([], pa.string()), pa.array([], pa.int64()))) == []
