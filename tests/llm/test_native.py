"""Chat formatting, secrets, personal data, decontamination, mixing and sharding against brute force and on odd input."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from larkspan.llm import chat, common, decontam, mixing, pii, queries, secrets, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "a", "é" * 50, "x" * 200_000, "1" * 5000, "password: " * 2000, "a@" * 3000, "same", "same", "\x00 \U0001f600 z"]


def test_prefix_sums_and_running(spark):
    d = spark.createDataFrame([(g, i, (i * 7) % 5) for g in (1, 2) for i in range(300)], "g int, i int, v long")
    rows = common.prefix_sums(d, ["g"], ["i"], "v", parts=7).collect()
    for r in rows:
        assert r["before"] == sum((k * 7) % 5 for k in range(r["i"])) and r["rank"] == r["i"]
    a = [random.Random(1).randrange(50) for _ in range(1000)]
    one = spark.createDataFrame([(a,), ([],)], "a array<long>")
    got = [r[0] for r in one.select(common.running(F.col("a"))).collect()]
    assert got == [[sum(a[:i]) for i in range(len(a))], []]


def test_chat_round_trip(spark):
    r = random.Random(5)
    pieces = ["\\", "###", "### ", "</turn>", "\n", "h", "s", "t", "c", ":", "user", "é", "<", "/turn>", "#", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a:b\\c", None]), r.choice([None, "".join(r.choice(pieces) for _ in range(r.randrange(9)))])) for c in range(60) for t in range(r.randrange(1, 7))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (99, 1, "user", "tie"), (99, 1, "user", "tie")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {x["conv_id"]: x for x in chat.format_conversations(d).select("*", chat.parse(F.col("formatted")).alias("back"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted(((t is not None, t or 0), role or "", text or "") for k, t, role, text in rows if k == c)
        assert [(b["role"], b["text"]) for b in out[c]["back"]] == [(role, text) for _, role, text in turns]
        assert out[c]["learned"] == [text for _, role, text in turns if role == "assistant"]
        blocks = sum(1 for i, x in enumerate(turns) if i == 0 or turns[i - 1][1] != x[1])
        assert out[c]["formatted"].count("### ") == blocks and out[c]["formatted"].count("</turn>") == len(turns)
    assert chat.format_conversations(d.limit(0)).count() == 0


def brute_secrets(t):
    out = []
    for k, (p, _, n) in enumerate(secrets.BASE.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m.group(2) if k == 0 else m.group()) >= n]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    texts += ['API_KEY = "abcdefgh1" password: token: abcdefghij é AKIAAKIA12345678 ' + "0f" * 20, "user=maria " + "x " * 300 + "q" * 10, "client_id=ab12 and Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9 at https://h.example/x", "only https://h.example/x here"]
    rows = secrets.find_secrets(docs_of(spark, texts)).select("doc_id", secrets.spans_sql(F.col("base")).alias("b"), secrets.spans_sql(F.col("spans")).alias("s")).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["b"] == brute_secrets(t or "") for i, t in enumerate(texts))
    weak = by[len(texts) - 2]["s"].split(",")
    assert [w.split(":")[0] for w in weak] == ["weak_identifier", "weak_secret", "endpoint"]
    assert by[len(texts) - 1]["s"] == "" and by[len(texts) - 3]["s"] == ""
    assert secrets.find_secrets(docs_of(spark, texts).limit(0)).count() == 0


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = []
    for k, p in enumerate((pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t for t in ODD if t is None or len(t) < 10_000]
    texts += ["a@b.com_x@y.z.w q@w.e. 1.2.3.4.5.6.7.8 999.1.2.3 0001.2.3.4 4111 1111 1111 1111 4111-1111-1111-1112 +1 (743) 555-3824 é@x.y"]
    first = len(texts)
    texts += [f"the contact zorblatt{'' if i % 2 else ' common'} is jo@corp.example today" for i in range(4)] + [f"the common contact is u{i}@corp.example today" for i in range(30)] + [f"the common contact says today number {i}" for i in range(30)]
    d = docs_of(spark, texts)
    rows = pii.find_personal_data(d).select("doc_id", secrets.spans_sql(F.col("base")).alias("b"), secrets.spans_sql(F.col("spans")).alias("s")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and all(by[i]["b"] == brute_pii(t or "") for i, t in enumerate(texts))
    for i in range(4):
        assert "term_removed:12:20" in by[first + i]["s"].split(",") and by[first + i]["s"].count("term") == 1
    assert all(by[i]["s"] == by[i]["b"] for i in range(first + 4, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert clean[first + 1] == "the contact  is [EMAIL] today" and clean[first + 34] == texts[first + 34]
    assert pii.find_personal_data(d.limit(0)).count() == 0


def test_decontamination(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (30, 30, 25, 12, 6, 2)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, items[0])], "item_id long, text string")
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    exact = [f"{noise(50)} {items[0].upper()}, {noise(9)}"]
    swapped = items[1].split()
    for k in (4, 11, 19, 26):
        swapped[k] = "other"
    moved = items[2].split()
    moved.insert(12, "inserted")
    texts = exact + [f"{noise(20)} {' '.join(swapped)} {noise(5)}", f"{' '.join(moved)}", f"a {items[3]}", items[4], items[5], noise(300), items[0][: len(items[0]) // 4], None, ""]
    docs = docs_of(spark, texts)
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_contamination(docs, bench).collect()}
    assert got == {(0, 0), (0, 50), (1, 1), (2, 2), (3, 3), (4, 4)}
    before = decontam.BROADCAST_SEEDS
    decontam.BROADCAST_SEEDS = 0
    try:
        assert {(x["doc_id"], x["item_id"]) for x in decontam.find_contamination(docs, bench).collect()} == got
    finally:
        decontam.BROADCAST_SEEDS = before
    left = decontam.decontaminate(docs, bench)
    assert sorted(x["doc_id"] for x in left.collect()) == [5, 6, 7, 8, 9] and left.columns == docs.columns
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0 and decontam.find_contamination(docs, bench.limit(0)).count() == 0


def fill(sizes, weights):
    """Targets by resharing the excess until none is above."""
    whole, full = 1.5 * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = whole - sum(2 * sizes[i] for i in full)
        w = sum(weights[i] for i in open_)
        target = [2.0 * sizes[i] if i in full else weights[i] * rest / w for i in range(len(sizes))]
        more = {i for i in open_ if target[i] >= 2 * sizes[i]}
        if not more:
            return target
        full |= more


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 41 == 0, None).otherwise(F.col("source")))
    docs = docs.union(spark.createDataFrame([(None, None, None, "src1", 0), (5, "x y", "en", "src1", 3), (5, "x y", "en", "src1", 3)], DOCS))
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count() and mixing.plan(docs.repartition(5)).exceptAll(mixing.plan(docs)).count() == 0
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        assert all(0 <= p["position"] <= 1 for p in r["passes"])
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    target = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, n, t in zip(names, sizes, target, strict=True):
        assert all(r["source_size"] == n and r["target"] == pytest.approx(t) for r in by[s])
        assert sum(r["taken"] for r in by[s]) == int(t + 0.5)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.plan(docs.limit(0)).count() == 0
    word = docs_of(spark, [None, "", "  "])
    assert [r["taken"] for r in mixing.plan(word).collect()] == [0, 0, 0]


def test_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").union(docs_of(spark, ["copy " * 9] * 40 + [None, "", "é"])).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    for k in range(8):
        own = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) < max(r["size"] for r in rows) + 0.03 * total / 8
    texts = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())): len((r["text"] or "").encode()) + 8 for r in docs.collect()}
    assert all(texts[r["doc_id"], r["text_crc32"]] == r["size"] for r in rows)
    whole = sharding.shard_with_texts(docs, 8)
    assert whole.columns == [*docs.columns[:-1], "shard", "slot"] and whole.count() == len(rows)
    assert whole.select("doc_id", "shard").distinct().exceptAll(spark.createDataFrame(rows).select("doc_id", "shard").distinct()).count() == 0
    assert sharding.shard_documents(docs.limit(0)).count() == 0 and sharding.shard_with_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    from tests.test_queries import both

    mine, theirs = both(spark, sf_dir, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert mine == theirs


def test_digests(spark, sf_dir):
    for name, brute in (("op2_secret_scan", brute_secrets), ("op7_pii", brute_pii)):
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        rows = queries.QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == len(texts)
        assert all(r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest() for r in rows)
