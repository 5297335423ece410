"""Exact self-join of documents by the Jaccard similarity of their word n-gram sets, size-aware.

Sets whose similarity is t or more share at least ceil(t |A|) elements, so in any global order of elements their
prefixes of |A| - ceil(t |A|) + k share k of them. Light sets enumerate the fixed-size subsets, of two
elements, of their prefixes for k = 2 and meet where a subset is equal; heavy sets post their prefixes for k = 1 to
inverted lists, which they and the light sets that are large enough for them scan. Enumeration costs
C(p, 2) signatures, scanning p times the length of the lists; the size from which scanning is cheaper is the boundary.
The order puts elements first that a sample of documents hasn't repeatedly; the sample shapes cost only, never results.

Equal sets are one class and never compared. Postings are dealt by element and sorted, so one pass over a list, which needs no
more memory than a batch, compares each of its classes with `HUBS` hubs, the first ones. Each posting has the size of its set and the
number of its elements from the posted one on: as a pair that links meets at the first element that both have, these bound the overlap, and
a pair that can't reach the similarity isn't tried. What links becomes one component. Only longer lists with other classes that are outside
the first hub's component are open, and only those strays are compared with the list's classes, across components: while that would be
many pairs, first with further hubs, as long as that links most of them to large groups, then in full, in a join whose condition has a further exact bound: bitmaps in which every element toggles a bit differ in no more bits than the sets
in elements. So groups of near copies cost their size, not its square, and no link between different components is lost: the
components are those of all links. Survivors are verified on whole sets.

Numpy on Arrow batches, in bounded chunks; elements are 64-bit hashes. Broadcast: at most `FREQUENT` sampled elements and a
Bloom filter of fixed size. Defined cases: documents without words have empty sets and link to nothing, nor to each other; those
of fewer words than n have one element; null ids take part and come last (their component is the smallest id that isn't
null in it, else null); repeated rows agree; other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.arrays import Counter, Recent, find, mix, pieces, words_of
from larkspan.llm.common import collect_garbage, durable, fewer, fresh, map_arrow, release, scratch, with_rows
from larkspan.llm.graph import components

#: Most elements that the order knows as frequent, one document in SAMPLE tells which; bits of a set's bitmap and of the filter.
FREQUENT, SAMPLE, BITS, FILTER = 1_000_000, 16, 1024, 1 << 26
#: Classes of a list that each other is compared with at first and in a round, rounds at most, and pairs for each row of open lists up to which these are compared in full at once.
HUBS, ROUNDS, FULL = 8, 2, 256
_FACTORS = [pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(64)]


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """For each text the distinct hashes of its n-word shingles, in order."""
    hashes, at = words_of(texts)
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled += hashes[k : k + len(rolled)] * np.uint64(_FACTORS[k])
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            part = sum(int(hashes[a + k]) * _FACTORS[k] for k in range(b - a)) + int(b - a)
            out.append(mix(np.array([part & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """The same for equal sets: a hash of the sum of hashes and the size. int64, 0 for the empty set."""
    size = np.array([len(s) for s in sets], np.int64)
    has = size > 0
    out = np.zeros(len(sets), np.uint64)
    if has.any():
        starts = np.concatenate(([0], np.cumsum(size[has])[:-1]))
        out[has] = mix(np.add.reduceat(mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F)), starts) + size[has].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return out.view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """BITS / 64 words for each set."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(of * BITS + (np.concatenate(sets) >> np.uint64(32)).astype(np.int64) % BITS, minlength=len(sets) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def need(n: int, percent: int) -> int:
    """ceil(t n)."""
    return -(-percent * n // 100)


def light_prefix(n: int, percent: int) -> int:
    return min(n, n - need(n, percent) + 2)


def boundary(length: float, percent: int) -> int:
    """The smallest size at which enumerating pairs costs more than scanning lists of this mean length."""
    n = 2
    while comb(light_prefix(n, percent), 2) <= (n - need(n, percent) + 1) * (1 + length):
        n += 1
    return n


#: Of each set: keys under which it is posted, and for each key how many elements it can share with a set it meets there first.
Posts = Callable[[list[np.ndarray], list], tuple[list[np.ndarray], list[np.ndarray]]]


def posted_sets(docs: DataFrame, n: int, posts: Posts, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, extra, n, sid, th (the text's hash), bits, keys and most of every document, written down.

    Of equal sets, only the first that a task has met of late has bits, keys and most.
    """
    docs = docs.select("doc_id", *extra, F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    lead = [*docs.columns[:-2], "th"]

    def run(batches):
        recent = Recent()
        for batch in batches:
            for a, b, texts in pieces(batch.column("text")):
                sets = shingle_sets(texts, n)
                sids = set_ids(sets)
                new = np.array([len(s) > 0 and recent.new(i) for s, i in zip(sets, sids.tolist(), strict=True)], bool)
                fresh_ = [s for s, k in zip(sets, new, strict=True) if k]
                keys, most = posts(fresh_, [t for t, k in zip(texts, new, strict=True) if k])
                ends = np.zeros(b - a + 1, np.int32)
                ends[1:][new] = [len(k) for k in keys]
                ends = np.cumsum(ends, dtype=np.int32)
                flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
                bits = np.concatenate(([0], np.cumsum(new * (BITS // 64)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, b - a) for c in lead],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sids),
                        pa.ListArray.from_arrays(pa.array(bits), pa.array(bitmaps(fresh_) if fresh_ else np.empty(0, np.int64)), mask=pa.array(~new)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(most, np.int32))),
                    ],
                    [*lead, "n", "sid", "bits", "keys", "most"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in lead)
    return durable(map_arrow(docs, run, f"{kinds}, n bigint, sid bigint, bits array<bigint>, keys array<bigint>, most array<int>"))


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Elements that sampled documents repeat, in order, how often, and the mean length of a list that this foretells."""

    def run(batches):
        counter = Counter(500_000)
        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                for kn in counter.add(np.concatenate(shingle_sets(texts, n))):
                    yield _counted(*kn)
        for kn in counter.rest():
            yield _counted(*kn)

    sample = docs.where(F.pmod(F.xxhash64(F.lit("order"), "doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = durable(map_arrow(sample, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    # the least count that admits no more than FREQUENT; classes of counts are powers of two
    classes = sorted(counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("k"), F.sum("n").alias("s")).collect(), key=lambda r: -r["c"])
    admitted, least = 0, None
    for r in classes:
        admitted += r["k"]
        if admitted > FREQUENT:
            break
        least = r["c"]
    t = counts.where(F.floor(F.log2("n")) >= (least if least is not None else 64)).toArrow()
    h, c = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
    at = np.argsort(h)
    release(counts)
    mean = sum(r["s"] for r in classes) / sum(r["k"] for r in classes) if classes else 1.0
    return h[at], c[at], mean


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


@cache
def _two(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of n elements."""
    return np.triu_indices(n, 1)


def prefixes(spark, percent: int, x: int, order: tuple[np.ndarray, np.ndarray]) -> Posts:
    """What sets smaller than x (light) and others post. Subsets and elements are different keys."""
    hold = spark.sparkContext.broadcast(order)

    def posted(s: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(s)
        # sets of one element link to their equals only
        if size < 2:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        s = s[np.argsort((np.minimum(f, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")]
        keys, most = [], []
        if size < x:
            first = s[: light_prefix(size, percent)]
            i, j = _two(len(first))
            low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            keys.append(mix(low ^ (high * np.uint64(_FACTORS[5]))))
            most.append(1 + size - j)
        # a light set scans lists if a heavy one can link to it
        if size * 100 >= x * percent:
            keys.append(s[: size - need(size, percent) + 1])
            most.append(size - np.arange(len(keys[-1])))
        return np.concatenate(keys), np.concatenate(most)

    def posts(sets, _):
        table, often = hold.value
        if not sets:
            return [], []
        at, have = find(table, np.concatenate(sets))
        f = np.where(have, often[at], 0) if len(table) else np.zeros(len(at), np.int64)
        ends = np.cumsum([0] + [len(s) for s in sets])
        made = [posted(s, f[ends[i] : ends[i + 1]]) for i, s in enumerate(sets)]
        return [m[0] for m in made], [m[1] for m in made]

    return posts


def posted_lists(sets: DataFrame) -> DataFrame:
    """h, sid, size: the keys under which sets are posted; size holds the number of elements and below it the most of them that two sets share that meet there first."""
    size = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("p.most").cast("long"))
    return sets.where(F.size("keys") > 0).select("sid", "n", F.explode(F.arrays_zip("keys", "most")).alias("p")).select(F.col("p.keys").alias("h"), "sid", size.alias("size"))


def met(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """hub, sid: pairs, each once, of a list's first `HUBS` classes with all others of it, if they can link; and h, sid, n, most, hub of the
    classes that aren't among the first of their lists, with the very first. Both from one written table.

    A pass over postings that are dealt by h and sorted; what goes from batch to batch is the head of one list.
    """
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        head, seen, last = np.empty((3, 0), np.int64), 0, None  # of the list that may go on: first rows, how many rows, the last
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            again = (rows[:2, 1:] == rows[:2, :-1]).all(0)
            rows = rows[:, np.concatenate(([last is None or (rows[:2, 0] != last).any()], ~again))] if batch.num_rows else rows
            if not rows.shape[1]:
                continue
            old = head.shape[1]
            h, sid, size = np.concatenate([head, rows], 1)
            at = np.arange(len(h))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], h[1:] != h[:-1])), at, 0))
            rank = at - start + ((start == 0) & (at >= old)) * (seen - old)
            n, most = size >> 32, size & 0xFFFFFFFF
            pairs = []
            for k in range(HUBS):
                i = np.flatnonzero((at >= old) & (rank > k))
                j = start[i] + k
                fit = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * np.minimum(most[i], most[j]) >= percent * (n[i] + n[j]))
                pairs.append(np.stack([sid[j[fit]], sid[i[fit]]], 1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            rest = np.flatnonzero((at >= old) & (rank >= HUBS))
            zero = np.zeros(len(pairs), np.int64)
            if len(pairs) + len(rest):
                columns = [(zero, h[rest]), (pairs[:, 1], sid[rest]), (zero, n[rest]), (zero, most[rest]), (pairs[:, 0], sid[start[rest]])]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in columns], pa.array(np.arange(len(pairs) + len(rest)) < len(pairs))], ["h", "sid", "n", "most", "hub", "pair"])
            first = start[-1]
            seen, last = int(rank[-1]) + 1, rows[:2, -1]
            head = np.stack([h, sid, size])[:, first : first + min(HUBS, seen)]

    dealt = lists.repartition(parts, "h").sortWithinPartitions("h", "sid")
    out = durable(map_arrow(fewer(dealt), run, "h bigint, sid bigint, n bigint, most bigint, hub bigint, pair boolean"))
    return out.where("pair").select("hub", "sid").distinct(), out.where("NOT pair").drop("pair")


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash) of FILTER bits over the column th: a row for each 64 of them at most is gathered."""
    at = F.expr(f"th & {FILTER - 1}")
    t = keys.select((F.shiftright(at, 6)).alias("w"), F.expr("shiftleft(1L, cast(th & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(FILTER // 64, np.uint64)
    words[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return words


def whole_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """sid, elements: of the sets in wanted (sid, th), 6 bytes of each hash, in order. Only texts with a th of wanted are read into words."""
    hold = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def run(batches):
        recent = Recent()
        for batch in batches:
            th = batch.column("th").to_numpy()
            maybe = hold.value[(th & (FILTER - 1)) >> 6] >> (th & 63).astype(np.uint64) & np.uint64(1) > 0
            maybe &= np.array([recent.new(t) if m else False for t, m in zip(th.tolist(), maybe, strict=True)], bool)
            for _, _, texts in pieces(batch.column("text").filter(pa.array(maybe))):
                sets = shingle_sets(texts, n)
                cut = [np.sort(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets)), pa.array(cut, pa.binary())], ["sid", "elements"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return map_arrow(texts, run, "sid bigint, elements binary").join(wanted.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("elements").alias("elements"))


def verified(docs: DataFrame, n: int, percent: int, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b, and the hashes of a text of each) of different sets that link: 100 |A and B| >= percent |A or B|."""
    one = lambda c: F.struct(F.col(c).alias("sid"), F.col(f"th_{c}").alias("th"))
    sets = durable(fewer(whole_sets(docs, n, pairs.select(F.inline(F.array(one("a"), one("b")))))))
    mine = pairs.select("a", "b").join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), "a")
    both = mine.join(sets.select(F.col("sid").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")

    def read(b: bytes) -> np.ndarray:
        wide = np.zeros((len(b) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        return wide.view(np.uint64).ravel()

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = read(x.as_py()), read(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = durable(map_arrow(fewer(both), run, "a bigint, b bigint"))
    release(sets)
    return out


def link_classes(docs: DataFrame, sets: DataFrame, n: int, percent: int, lists: DataFrame | None = None) -> DataFrame:
    """sid, root: the components, of more than one class of equal sets, by links between classes that meet in a list; lists: as posted_lists(sets) gives them."""
    spark = docs.sparkSession
    pairs, lists = met(posted_lists(sets) if lists is None else lists, percent)
    collect_garbage(spark)
    facts = durable(fewer(sets.where("n > 1").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.min("th").alias("th"))))
    of = lambda c: facts.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"), F.col("th").alias(f"th_{c}"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, k: s + k)
    can = differ * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    pairs = pairs.select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    tried = durable(fewer(pairs.join(of("a"), "a").join(of("b"), "b").where(can).select("a", "b", "th_a", "th_b")))
    links = verified(docs, n, percent, tried)
    roots = components(links)
    before = None
    for turn in range(ROUNDS + 1):
        held = still_open(lists, roots, facts)
        sizes = fewer(held.select("h", "size", "strays").distinct())
        share = F.greatest(F.lit(1).cast("long"), F.expr(f"size div {HUBS}"))
        whole = sizes.agg(F.sum("size").alias("rows"), F.sum("strays").alias("strays"), F.sum(F.col("size") / share).alias("hubs"), F.sum(F.col("size") * F.col("strays")).alias("pairs")).first()
        strays = held.where("NOT home")
        # further hubs link what is in groups; where a round has left most strays, they are in none
        full = turn == ROUNDS or (whole["pairs"] or 0) <= FULL * (whole["rows"] or 0) or (before is not None and 2 * whole["strays"] > before)
        before = whole["strays"]
        if full:
            ordered = F.col("home_b") | (F.col("sid_a") < F.col("sid_b"))
            rest = apart(strays, held, ordered & can, percent)
        else:
            hubs = held.where(F.pmod(F.xxhash64(F.lit(turn), "sid"), share) == 0)
            rest = apart(strays, hubs, can, percent, few=whole["hubs"] < whole["strays"])
        rest = durable(fewer(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti")))
        release(held)
        if not rest.isEmpty():
            more = verified(docs, n, percent, rest)
            if not more.isEmpty():
                roots = components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        if full:
            break
        tried = tried.union(rest)
        collect_garbage(spark)
    return roots.select(F.col("node").alias("sid"), F.col("component").alias("root"))


def still_open(lists: DataFrame, roots: DataFrame, facts: DataFrame) -> DataFrame:
    """h, sid, n, most, root, home (whether that is the hub's), size and strays (classes that aren't home) of the list, and facts of lists with classes that nothing has linked to the hub's component; the hub is left out."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}"))
    # lists of the same classes have the same hub, so a class of a large group is looked up once, not once for each of its lists
    told = lists.select("hub", "sid").distinct().join(root("sid"), "sid", "left").join(root("hub"), "hub", "left")
    told = told.withColumn("root", F.coalesce("root_sid", "sid"))
    told = durable(fewer(told.select("hub", "sid", "root", (F.col("root") == F.coalesce("root_hub", "hub")).alias("home"))))
    placed = durable(fewer(lists.join(told, ["hub", "sid"]).select("h", "sid", "n", "most", "root", "home")))
    # in lists of several components there are classes that aren't at home
    open_ = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.count_if(~F.col("home")).alias("strays")).where("lo < hi").drop("lo", "hi")
    out = durable(fewer(placed.join(open_, "h").join(facts.drop("n"), "sid")))
    release(told, placed)
    return out


def apart(some: DataFrame, others: DataFrame, can, percent: int, few: bool = False) -> DataFrame:
    """a, b: pairs of classes of different components that meet in a list and can link. Sizes that can are in the same class of sizes or the next,
    and it is some that look into three of these, or others where they are few."""
    size = F.floor(F.log("n") / np.log(100 / percent)).cast("int")
    side = lambda df, c: df.select("h", "size", *[F.col(x).alias(f"{x}_{c}") for x in ("sid", "n", "most", "root", "bits", "th", "home")])
    fit = (F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")) & (F.least("most_a", "most_b") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    wide = lambda df, all_: df.withColumn("size", F.explode(F.array(size - 1, size, size + 1)) if all_ else size)
    pairs = side(wide(some, not few), "a").join(side(wide(others, few), "b"), ["h", "size"]).where((F.col("root_a") != F.col("root_b")) & fit & can)
    low = F.col("sid_a") < F.col("sid_b")
    of = lambda x, y: [F.when(low, F.col(f"sid_{x}")).otherwise(F.col(f"sid_{y}")), F.when(low, F.col(f"th_{x}")).otherwise(F.col(f"th_{y}"))]
    (a, th_a), (b, th_b) = of("a", "b"), of("b", "a")
    return pairs.select(a.alias("a"), b.alias("b"), th_a.alias("th_a"), th_b.alias("th_b")).distinct()


def grouped(docs: DataFrame, n: int, percent: int, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, extra, n, sid, root (the same for all of a component) and least, the smallest doc_id of it. Written down."""
    with scratch() as keep:
        table, often, length = frequent(docs, n)
        posts = prefixes(docs.sparkSession, percent, boundary(length, percent), (table, often))
        sets = posted_sets(docs, n, posts, extra)
        return keep(durable(with_least(sets, link_classes(docs, sets, n, percent), extra)))


def with_least(sets: DataFrame, roots: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """sets with root and least. Minima are taken by class, then by component, so that rows are joined once."""
    classes = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("own")).join(roots, "sid", "left")
    least = classes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("own").alias("least"))
    told = classes.join(least, "root", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("least")).alias("least"))
    columns = ["doc_id", *extra, "n", "sid"]
    alone = sets.where("n = 0").select(*columns, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("least"))
    return sets.where("n > 0").select(*columns).join(told, "sid").select(*columns, "root", "least").union(alone)


def group_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach from a document, its own included."""
    return grouped(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all columns: that of the smallest doc_id, of several rows with that id, or where none has one, any
    one row, the same in each run over the same files. Documents without words are in no group and stay."""
    row = fresh(docs, "_row")
    rows = with_rows(docs, row)
    with scratch() as keep:
        groups = grouped(rows.select("doc_id", "text", F.col(row).alias("_row")), n, percent, ("_row",)).where(F.col("root").isNotNull())
        first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("f"), F.count("*").alias("k")).where("k > 1").select("root", F.col("f._row").alias("_first"))
        # written, so that its size is known and a small one is broadcast rather than texts shuffled
        dropped = keep(durable(groups.join(first, "root").where("_row <> _first").select(F.col("_row").alias(row))))
    return rows.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
