"""Hard negatives, vector codes and chosen paths against brute force, on ordinary and on odd input; test_native has their SQL."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import chosen_path, hard_negatives, jaccard_join, quantize

VECTORS = "vec_id long, embedding array<double>, label int, row long, v string, id string, code string, PIVOT string"
NAN, INF = float("nan"), float("inf")


def odd_vectors(n=700, dim=8, seed=1):
    """Groups, a vector that a third of all rows have, ties, repeated rows and rows that don't count."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dim))
    rows = [(i, (middle[i % 6] + r.normal(scale=0.3, size=dim)).tolist() if i % 3 else middle[0].tolist(), int(r.integers(0, 10))) for i in range(n)]
    rows += [rows[100], rows[7], (None, rows[8][1], 3), (n + 100, None, 1), (n + 200, [NAN] * dim, 1), (n + 300, [INF] * dim, 1), (n + 400, [None, *[0.5] * (dim - 1)], 1), (-100, [0.0] * dim, 4), (-7, rows[9][1], None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, i, "v", "id", "code", "p") for i, x in enumerate(rows)], VECTORS)


def counting(rows, factor, label):
    """Rows that count, with whole vectors."""
    ok = [x for x in rows if x[1] is not None and all(c is not None and np.isfinite(c) for c in x[1]) and (not label or x[2] is not None)]
    return ok, np.array([np.floor(factor * np.array(x[1])) for x in ok]).astype(np.int64)


def brute_negatives(rows, k=5):
    ok, v = counting(rows, 256, True)
    label = [(x[2] + 1) % 10 if x[0] is not None and x[0] % 7 == 0 else x[2] for x in ok]
    ident = [np.inf if x[0] is None else x[0] for x in ok]
    out = []
    for a, x in enumerate(ok):
        if x[0] is None or x[0] % 100:
            continue
        score = (v @ v[a]).tolist()
        by = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-score[b], ident[b]))
        for p in [b for b in by if label[b] == label[a]][:k]:
            fit = [b for b in by if label[b] != label[a] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:k]
            out += [(x[0], ok[p][0], i + 1, ok[b][0], score[p], score[b]) for i, b in enumerate(fit)]
    return collections.Counter(out)


@pytest.mark.parametrize("first,block,dim", [(4096, 4096, 8), (1, 3, 8), (40, 4, 2)])
def test_hard_negatives(spark, monkeypatch, first, block, dim):
    """With small first annuli and blocks, queries take several rounds and go in several blocks."""
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = odd_vectors(dim=dim)
    got = collections.Counter(tuple(r) for r in hard_negatives.mined(frame(spark, rows)).collect())
    assert got == brute_negatives(rows) and len(got) > 20


def test_annuli_prune(spark, monkeypatch):
    """Groups far apart: most rows lie outside of every interval that a query scans."""
    r = np.random.default_rng(3)
    middle = 50 * r.normal(size=(20, 6))
    rows = [(i, (middle[i % 20] + r.normal(size=6)).tolist(), int(i % 3)) for i in range(2000)]
    seen, scanned = [], hard_negatives.scanned

    def counted(index, block, k):
        own = hard_negatives.distances(np.concatenate([block["v"].astype(float), np.zeros((len(block["v"]), 1))], 1), index.pivots)
        far = index.table.select("pivot", "far").toPandas()
        seen.append(((np.abs(own[:, far["pivot"].to_numpy()] - far["far"].to_numpy()[None]) <= block["outer"][:, None]).mean()))
        return scanned(index, block, k)

    monkeypatch.setattr(hard_negatives, "scanned", counted)
    monkeypatch.setattr(hard_negatives, "FIRST", 64)
    got = collections.Counter(tuple(x) for x in hard_negatives.mined(frame(spark, rows)).collect())
    assert got == brute_negatives(rows) and seen[0] < 0.5


def brute_codes(rows, entries=256):
    ok, v = counting(rows, 1024, False)
    order = sorted(range(len(ok)), key=lambda i: (np.inf if ok[i][0] is None else ok[i][0], v[i].tolist()))
    part = v.reshape(len(v), 4, -1)
    books = part[order[:entries]].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((part[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(4)], 1)
    for _ in range(4):
        at = nearest()
        for p in range(4):
            for e in set(at[:, p].tolist()):
                mine = part[at[:, p] == e, p]
                books[p, e] = mine.sum(0) // len(mine)
    at = nearest()
    error = sum(((part[:, p] - books[p][at[:, p]]) ** 2).sum(1) for p in range(4))
    whole = collections.Counter()
    for x, e in zip(ok, error.tolist(), strict=True):
        whole[x[2]] += e
    book = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return collections.Counter((x[0], "".join(f"{c:02x}" for c in a), int(e), whole[x[2]], book) for x, a, e in zip(ok, at.tolist(), error, strict=True))


@pytest.mark.parametrize("n", [700, 30])
def test_codes(spark, n):
    rows = [(i, v, None if i is not None and i % 11 == 0 else lab) for i, v, lab in odd_vectors(n, seed=4) if i is None or i != 100 or n > 100] if n > 100 else [(i, [float(i % 7), 1.0, -1.0, i / 3], i % 2) for i in range(n)]
    got = collections.Counter(tuple(r) for r in quantize.compressed_codes(frame(spark, rows)).collect())
    assert got == brute_codes(rows)


def test_only_changes_are_handed_on(spark, monkeypatch):
    """The contributions of a round, added up, are the differences between the sums of its assignments and the last."""
    rows = odd_vectors(600, seed=6)
    steps, changes = [], quantize.changes
    monkeypatch.setattr(quantize, "changes", lambda t, b: steps.append((t.where("part IS NOT NULL").selectExpr("sum(abs(n))").first()[0] or 0, changes(t, b))) or steps[-1][1])
    quantize.compress(frame(spark, rows), entries=16)
    counts = sum(s[1][0] for s in steps)
    assert (counts.sum(1) == len(counting(rows, 1024, False)[0])).all() and (counts >= 0).all()
    # no more than one added and one taken for each part that has moved, so less and less
    v = counting(rows, 1024, False)[1]
    first = sorted(range(len(v)), key=lambda i: (np.inf if counting(rows, 1024, False)[0][i][0] is None else counting(rows, 1024, False)[0][i][0], v[i].tolist()))[:16]
    books = v[first].reshape(16, 4, -1).transpose(1, 0, 2).copy()
    before = np.full((len(v), 4), -1)
    for handed, _ in steps:
        now = quantize.nearest(v, books)[0]
        moved = now != before
        assert 0 < handed <= moved.sum() + (before[moved] >= 0).sum() and (before[0, 0] < 0 or moved.sum() < moved.size)
        for p in range(4):
            for e in set(now[:, p].tolist()):
                books[p, e] = v[now[:, p] == e].reshape(-1, 4, books.shape[2])[:, p].sum(0) // (now[:, p] == e).sum()
        before = now


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2), (2, [NAN] * 4, 2)]):
        assert hard_negatives.mined(frame(spark, rows)).collect() == [] and quantize.compressed_codes(frame(spark, rows)).collect() == []
    for f in (hard_negatives.mined, quantize.compressed_codes):
        with pytest.raises(Exception, match="one length|components each"):
            f(frame(spark, [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0], 1)])).collect()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_components(texts, n, percent):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (ident, _) in enumerate(texts):
        r = find(i)
        if ident is not None:
            least[r] = min(least.get(r, ident), ident)
    return sorted(repr((texts[i][0], len(s), least.get(find(i)) if s else texts[i][0], texts[i][0] is not None and (texts[i][0] == least.get(find(i)) if s else True))) for i, s in enumerate(sets))


def family(r, size, kept, vocabulary, many):
    """Texts that repeat most of one text each."""
    whole = [r.choice(vocabulary) for _ in range(size)]
    return [" ".join(w if r.random() < kept else r.choice(vocabulary) for w in whole) for _ in range(many)]


@pytest.mark.parametrize("small", [jaccard_join.HUBS + 1, 3])
def test_chosen_paths(spark, monkeypatch, small):
    """Families of copies at all degrees of likeness, shared passages and odd rows; columns have names that are used inside."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [t for kept in (1.0, 0.99, 0.97, 0.95, 0.93, 0.9) for t in family(r, 150, kept, vocabulary, 25)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts += [f"{passage} {t}" for t in family(r, 40, 0.0, vocabulary, 60)]
    texts += [" ".join(f"long{i % 7919}" for i in range(20_000))] * 2 + ["one", "One", "two words", "two  WORDS", "", None, " \n ", "x" * 200_000]
    rows = [*enumerate(texts), (None, texts[0]), (None, "alone without an id"), (3, texts[3]), (3, "another text of this id")]
    docs = spark.createDataFrame([(i, t, "h", "n", "k", 1) for i, t in rows], "doc_id long, text string, H string, n string, keys string, sid int").repartition(5)
    got = sorted(repr(tuple(x)) for x in chosen_path.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_components(rows, 2, 80)
    assert chosen_path.near_duplicates(docs.limit(0)).collect() == []


def test_trees_reach_the_recall():
    """Pairs at exactly the threshold, with all nodes large, meet in one of the trees as often as aimed at."""
    r = np.random.default_rng(1)
    sets = []
    for _ in range(1500):
        b = r.integers(0, 2**63, 400).astype(np.uint64)
        sets += [b[:360], np.concatenate([b[:320], b[360:]])]
    signatures = np.stack(chosen_path.signed(sets, None)[0])
    for recall in (0.9, 0.999):
        everything = np.full(chosen_path.FILTER // 64, 2**64 - 1, np.uint64)
        *_, (_, node, of, _) = chosen_path.descend(signatures, chosen_path.trees_for(recall, 80), everything, np.zeros_like(everything), chosen_path.DEPTH)
        order = np.argsort(of, kind="stable")
        parts = np.split(node[order], np.searchsorted(of[order], np.arange(1, len(sets))))
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(parts[::2], parts[1::2], strict=True)]) > recall - 0.01
