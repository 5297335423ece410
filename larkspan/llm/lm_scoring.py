"""Language-model scores by a probabilistic suffix tree over words.

Contexts are the last words before a token, up to `order`, of varying length. An n-gram counts if it occurs `floor` times
at least, whatever the size of the corpus, so what is kept grows with the input; a context is retained if its next-symbol
distribution diverges from that of its suffix - the log-likelihood that it gains over its own occurrences exceeds
`gain` for each next word it knows. A token is scored in the longest retained suffix of what
precedes it. Distributions are smoothed by absolute discounting: what is discounted from a context's counts goes to
its suffix's distribution, down to the root, where all unknown words together have V / (N + V), as in Witten-Bell smoothing,
and the words share the rest in proportion to c + 1. So each state's probabilities sum to 1 over the V known words and the unknown one.

A token's log probability is a sum: that of its word at the root, of each retained context before it the weight for the
suffix, and for each n-gram that a retained context knows, its gain over these. So a document's score is a sum of one value
for each n-gram it holds, and contexts and continuations are tables of key and value, joined with the documents' n-grams.

Numpy on Arrow batches, in bounded chunks; words and n-grams are 64-bit hashes. What is broadcast is bounded by parameters and
saves work only: the head of the tables (words and n-grams of at least a share p of all tokens, at most 1 / p for
each length) and filters of fixed size over the keys of the rest. All else stays in distributed tables, which meet the texts by slices of the keys.

Defined cases: a null text is empty and has the end token alone; ids of null train, by an empty id; rows are told
apart by a generated number, so tied and repeated rows are scored each for itself; long texts are scored whole; with no training tokens N and V
are 0 and every token has probability 1; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import contextlib
import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.arrays import Counter, Index, find, mix, pieces, summed, words_of
from larkspan.llm.common import collect_garbage, durable, map_arrow, only_scan, release, scratch

#: The end of a text, a symbol beside the words.
END = np.uint64(0x656E64656E64656E)
#: What stands before the first word, a context only.
START = np.uint64(0x7374617274737461)
#: Shares of all tokens from which words and n-grams are broadcast.
FREQUENT = 1e-6
HEAD = 4e-6
#: Occurrences that make an n-gram count.
FLOOR = 2
ORDER = 2
DISCOUNT = 0.75
GAIN = 2.0
#: 64-bit words of a filter.
SLOTS = 1 << 21
#: Ranges of a filter's words, each of which is a row.
RANGES = 1 << 12
#: Passes over the texts, each for a share of the keys, in which documents' n-grams are looked up, so that less is shuffled at a time.
PARTS = 1
#: Tokens, or keys of a table, for each slice of the keys; a slice is held by one worker at a time. N-grams that a task counts before it sends them.
SLICE, SENT = 250_000, 1_000_000
#: Bytes of a batch of arrays, so that a worker and the JVM hold few of them whatever their number in a task.
BATCH = 8 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each text, and bounds of texts."""
    h, at = words_of(texts)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def _batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def count(texts: DataFrame, keys) -> DataFrame:
    """h, n: how often keys(tokens, bounds) has each key over all rows of `texts`, a table of that column alone."""

    def run(batches):
        counter = Counter(500_000)
        for batch in batches:
            for _, _, part in pieces(batch.column(0)):
                for kn in counter.add(keys(*tokens_of(part))):
                    yield _batch(*kn)
        for kn in counter.rest():
            yield _batch(*kn)

    return map_arrow(texts, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and counts. Only for what a share of all tokens bounds."""
    t = df.select("h", "n").toArrow()
    h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
    at = np.argsort(h)
    return h[at], n[at]


def gathered_values(df: DataFrame) -> list[np.ndarray]:
    """Keys in order and values of a table key, value. Only for what a share of all tokens bounds."""
    t = df.toArrow()
    keys, values = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
    at = np.argsort(keys)
    return [keys[at], values[at]]


def filter_bits(keys: np.ndarray) -> np.ndarray:
    """Of each key the two bits that it sets in its word of a filter."""
    one = np.uint64(1)
    return (one << ((keys >> np.uint64(21)) & np.uint64(63))) | (one << ((keys >> np.uint64(27)) & np.uint64(63)))


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of SLOTS words over the column key. Tasks' words meet by ranges of them."""
    width = SLOTS // RANGES

    def local(batches):
        words = np.zeros(SLOTS, np.uint64)
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            slot = (k & np.uint64(SLOTS - 1)).astype(np.int64)
            order = np.argsort(slot)
            slot = slot[order]
            at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))[: len(slot)]
            if len(at):
                words[slot[at]] |= np.bitwise_or.reduceat(filter_bits(k)[order], at)
        at = np.flatnonzero(words)
        ends = np.searchsorted(at, np.arange(0, SLOTS + 1, width))
        some = np.flatnonzero(np.diff(ends))
        blobs = [(at[a:b] - p * width).astype(np.uint32).tobytes() + words[at[a:b]].tobytes() for p, a, b in zip(some.tolist(), ends[some].tolist(), ends[some + 1].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(blobs, pa.binary())], ["p", "blob"])

    def whole(batches):
        held: dict[int, np.ndarray] = {}  # ranges of this task, RANGES at most in all
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_buffer()
                k = raw.size // 12
                words = held.setdefault(p, np.zeros(width, np.uint64))
                words[np.frombuffer(raw, np.uint32, k)] |= np.frombuffer(raw[4 * k :], np.uint64, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([w.tobytes() for w in held.values()], pa.binary())], ["p", "blob"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "p bigint, blob binary"
    out = np.zeros(SLOTS, np.uint64)
    # at most RANGES rows
    for p, blob in map_arrow(map_arrow(keys, local, schema).repartition(min(parts, RANGES), "p"), whole, schema).collect():
        out[p * width : (p + 1) * width] = np.frombuffer(bytes(blob), np.uint64)
    return out


def maybe(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for a key that isn't in the filter."""
    bits = filter_bits(keys)
    return bloom[(keys & np.uint64(SLOTS - 1)).astype(np.int64)] & bits == bits


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of an n-gram from those of its first n - 1 symbols and of its last n - 1."""
    return mix(mix(context + np.uint64(0x9E3779B97F4A7C15)) ^ (suffix * np.uint64(0x100000001B3)))


def grams(tokens: np.ndarray, bounds: np.ndarray, order: int):
    """For each length of context up to `order`: of each token the keys of its context, of the n-gram without the first
    symbol and of the n-gram, and whether so much precedes it."""
    since = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    key = tokens
    for length in range(1, order + 1):
        context = np.empty_like(key)
        context[1:] = key[:-1]
        context[since == 0] = START
        suffix, key = key, joined(context, key)
        yield context, suffix, key, since >= length - 1


class Tree:
    """The frequent words, and of contexts and n-grams the head of what they add to a log probability."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int):
        self.words, self.counts, self.n, self.v = words, counts, n, v
        self.root = np.log10((counts + 1) * (n / (n + v) ** 2)) if n else np.zeros(len(words))
        self.base = np.log10((counts + 1) / (n + v + 1))
        #: by place, what a word is in keys
        self.common = words
        self.contexts: list[list[np.ndarray]] = []  # for each length: keys, log10 of the weight for the suffix
        self.next: list[list[np.ndarray]] = []  # for each length: keys of context and word, log10 of the gain over weight and suffix
        self.tail: np.ndarray = np.zeros(SLOTS, np.uint64)  # filter of n-grams beyond the head

    def ready(self) -> None:
        """Sets up what scoring searches, once all tables are there."""
        self.places = Index(self.words)
        #: by place, what a word adds by itself and as the context of what follows it
        self.own = self.root.copy()
        self.opening = 0.0
        self.levels = []  # for each length: keys and values of n-grams, and of the contexts that are longer by one
        for k, known in enumerate(self.next):
            longer = self.contexts[k + 1] if k + 1 < len(self.contexts) else None
            self.levels.append(((Index(known[0]), known[1]), longer and (Index(longer[0]), longer[1])))
        if self.contexts:
            keys, weights = self.contexts[0]
            at, have = find(keys, self.words)
            if have.any():
                self.own[have] += weights[at[have]]
            at, have = find(keys, np.array([START]))
            self.opening = weights[at[0]] if have[0] else 0.0

    def parent(self, length: int, suffix: np.ndarray, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of words after the suffix of `length`, as far as the head knows; suffix[k - 1]: the key of its last k symbols."""
        out, key = self.root[place].copy(), word
        for k in range(1, length + 1):
            key = joined(suffix[k - 1], key)
            for table, keys in ((self.contexts[k - 1], suffix[k - 1]), (self.next[k - 1], key)):
                at, have = find(table[0], keys)
                if have.any():
                    out[have] += table[1][at[have]]
        return out


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(slices)).astype(np.int64)


def sliced(keys: np.ndarray, slices: int):
    """The order of keys by slice, and of each slice that has some its number and range in that order."""
    of = slice_of(keys, slices)
    order = np.argsort(of.astype(np.uint16) if slices < 1 << 16 else of, kind="stable")
    found, first = np.unique(of[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)][: len(found)], strict=True))


def merged(c: np.ndarray, s: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams: c, s, sums of n (1 each) and keys, by key."""
    key = joined(c, s)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(at, len(key))) if n is None else np.add.reduceat(n[order], at)
    return c[order[at]], s[order[at]], n, key[at]


def count_grams(texts: DataFrame, length: int, floor: int, slices: int, known=None) -> DataFrame:
    """c, s, n, key: how often, `floor` times at least, a word follows a context of `length`, by the keys of the context and of the n-gram without its first symbol.

    known: a broadcast filter of the shorter n-grams that count; others are part of none that does. What a task has counted goes by slices of
    the keys, as arrays in one value, to where a slice is summed; a worker holds the distinct n-grams of one slice.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches):
        def send(held):
            c, s, n, key = merged(*[np.concatenate(x) for x in zip(*held, strict=True)])
            order, found = sliced(key, slices)
            c, s, n = c[order], s[order], n[order].astype(np.int32)
            blobs = [c[a:b].tobytes() + s[a:b].tobytes() + n[a:b].tobytes() for _, a, b in found]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array(blobs, pa.binary())], ["p", "blob"])

        held, size = [], 0
        for batch in batches:
            for _, _, part in pieces(batch.column(0)):
                *_, (context, suffix, _, ok) = grams(*tokens_of(part), length)
                if known is not None:
                    # a context is what the suffix was a token before; where none precedes, so much doesn't
                    have = maybe(known.value, suffix)
                    ok[1:] &= have[:-1]
                    ok &= have
                at = np.flatnonzero(ok)
                held.append((context[at], suffix[at]))
                size += len(at)
                if size > SENT:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def summed_up(batches):
        held, size, now = [], 0, None

        def done():
            c, s, n, key = merged(*[np.concatenate(x) for x in zip(*held, strict=True)])
            at = n >= floor
            return pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in (c, s, n, key)], ["c", "s", "n", "key"])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != now and held:
                    yield done()
                    held, size = [], 0
                now = p
                raw = blob.as_buffer()
                k = raw.size // 20
                held.append((np.frombuffer(raw, np.uint64, k), np.frombuffer(raw, np.uint64, k, 8 * k), np.frombuffer(raw, np.int32, k, 16 * k).astype(np.int64)))
                size += k
                if size > 4 * SLICE:
                    held = [merged(*[np.concatenate(x) for x in zip(*held, strict=True)])[:3]]
                    size = len(held[0][0])
        if held:
            yield done()

    dealt = map_arrow(texts, counted, "p bigint, blob binary").repartition(parts, "p").sortWithinPartitions("p")
    return map_arrow(dealt, summed_up, "c bigint, s bigint, n bigint, key bigint")


def level(counted: DataFrame, below: DataFrame, gain: float, last: bool) -> tuple[DataFrame, DataFrame]:
    """Contexts that are retained (key, n, value: log10 of the weight for the suffix), and n-grams: key, n, log10 probability lp,
    and value, what that is above weight and suffix; null where the context isn't retained and the suffix decides.

    counted: c, s, n, key; below: key, n, lp of all n-grams shorter by one. last: nothing is built on these n-grams, so that
    of those with a value key, n and value are enough.
    """
    # by suffix first, then by context: what follows stays dealt by it
    rows = counted.join(below.select(F.col("key").alias("s"), F.col("lp").alias("parent")), "s")
    rows = durable(rows.join(below.select(F.col("key").alias("c"), F.col("n").alias("total")), "c").select("c", "key", "n", "parent", "total"), ["c", "key"])
    collect_garbage(rows.sparkSession)
    weight = rows.groupBy("c").agg((1 - F.sum(F.col("n") - DISCOUNT) / F.max("total")).alias("weight"))
    log = lambda x: F.log(F.greatest(x, F.lit(1e-300)))
    own = rows.join(weight, "c").withColumn("p", (F.col("n") - DISCOUNT) / F.col("total") + F.col("weight") * F.pow(F.lit(10.0), "parent"))
    more = own.groupBy("c").agg(
        F.first("weight").alias("weight"),
        F.max("total").alias("n"),
        F.count("*").alias("next"),
        (F.sum(F.col("n") * (log(F.col("p")) - F.col("parent") * np.log(10))) + (F.max("total") - F.sum("n")) * F.log(F.greatest(F.first("weight"), F.lit(1e-12)))).alias("more"),
    )
    contexts = durable(more.where(F.col("more") > gain * F.col("next")).select(F.col("c").alias("key"), "n", F.log10(F.greatest("weight", F.lit(1e-12))).alias("value"), "weight"), ["key"])
    collect_garbage(rows.sparkSession)
    told = rows.join(contexts.select(F.col("key").alias("c"), "value", "weight"), "c", "inner" if last else "left")
    p = F.log10((F.col("n") - DISCOUNT) / F.col("total") + F.col("weight") * F.pow(F.lit(10.0), "parent"))
    lp = [] if last else [F.coalesce(p, "parent").alias("lp")]
    known = durable(told.select("key", "n", *lp, (p - F.col("value") - F.col("parent")).alias("value")), ["key"])
    release(rows)
    collect_garbage(contexts.sparkSession)
    return contexts, known


def train(texts: DataFrame, order: int = ORDER, gain: float = GAIN, floor: int = FLOOR) -> tuple[Tree, tuple[DataFrame, list[DataFrame]]]:
    """The tree, the table of all words' counts and weights as contexts (h, n, value), and tables of key and value of n-grams
    beyond the head, from a table of the column text."""
    spark = texts.sparkSession
    counts = durable(count(texts, lambda tokens, _: tokens))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"]), int(whole["v"])
    # at most 1 / FREQUENT words
    tree = Tree(*gathered(counts.where(F.col("n") >= FREQUENT * n)), n, v)
    if not n:
        return tree, (counts.withColumn("value", F.lit(None).cast("double")), [])
    end = np.array([END]).view(np.int64)[0].item()
    start = np.array([START]).view(np.int64)[0].item()
    # a text has one start and one end
    starts = counts.where(F.col("h") == end).select(F.lit(start).alias("key"), "n", F.lit(0.0).alias("lp"))
    below = counts.select(F.col("h").alias("key"), "n", F.log10((F.col("n") + 1) * F.lit(n / (n + v) ** 2)).alias("lp")).union(starts)
    tables, known = [], None
    for length in range(1, order + 1):
        collect_garbage(spark)
        counted = durable(count_grams(texts, length, floor, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SLICE), known), ["c", "s", "key"])
        collect_garbage(spark)
        contexts, below = level(counted, below, gain, length == order)
        release(counted)
        head = (F.col("n") >= (HEAD if length > 1 else FREQUENT) * n) | (F.col("key") == start)
        tree.contexts.append(gathered_values(contexts.where(head).select("key", "value")))
        tree.next.append(gathered_values(below.where((F.col("n") >= HEAD * n) & F.col("value").isNotNull()).select("key", "value")))
        if length == 1:
            weights = contexts.where(F.col("n") < FREQUENT * n).select(F.col("key").alias("h"), "value")
        else:
            tables.append(contexts.where(F.col("n") < HEAD * n).select("key", "value"))
        tables.append(below.where((F.col("n") < HEAD * n) & F.col("value").isNotNull()).select("key", "value"))
        if length < order:
            known = spark.sparkContext.broadcast(filter_of(below.select("key")))
    keys = [t.select("key") for t in tables]
    if keys:
        tree.tail = filter_of(reduce(DataFrame.union, keys))
    collect_garbage(spark)
    return tree, (counts.join(weights, "h", "left") if order else counts.withColumn("value", F.lit(None).cast("double")), tables)


def looked_up(texts: DataFrame, tail, length: int, values: list[DataFrame], part: int, slices: int) -> DataFrame:
    """_row, far: the sums of values (key, value) over the n-grams of each text (_row, text) that are beyond the head and in this part of the keys. tail: a broadcast filter of these.

    Tables and what documents ask of them are dealt by slices of the keys, as arrays in one value; a worker holds one slice of the tables, past which
    the questions stream. Answers go back to their texts in the same way.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda keys: (keys >> np.uint64(20)) % np.uint64(PARTS) == part

    numbers = lambda docs: np.uint16 if docs <= 1 << 16 else np.uint32

    def tables(batches):
        for batch in batches:
            keys, value = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order, found = sliced(keys, slices)
            keys, value = keys[order], value[order]
            blobs = [keys[a:b].tobytes() + value[a:b].tobytes() for _, a, b in found]
            if found:
                none = np.zeros(len(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array(none - 1), pa.array(none), pa.array(blobs, pa.binary())], ["p", "base", "docs", "blob"])

    def asked(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for a, b, part_ in runs(rows, batch.column(1)):
                tokens, bounds = tokens_of(part_)
                of = np.repeat(np.arange(b - a, dtype=numbers(b - a)), np.diff(bounds))
                keys, docs = [], []
                for _, _, key, ok in grams(tokens, bounds, length):
                    at = np.flatnonzero(ok & own(key))
                    at = at[maybe(tail.value, key[at])]
                    keys.append(key[at])
                    docs.append(of[at])
                keys, docs = np.concatenate(keys), np.concatenate(docs)
                order, found = sliced(keys, slices)
                keys, docs = keys[order], docs[order]
                blobs = [keys[x:y].tobytes() + docs[x:y].tobytes() for _, x, y in found]
                if found:
                    same = np.ones(len(found), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array(same * rows[a]), pa.array(same * (b - a)), pa.array(blobs, pa.binary())], ["p", "base", "docs", "blob"])

    def answered(batches):
        now, held, table = None, [], None
        told = lambda out: pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["base", "blob"])
        for batch in batches:
            out, size = [], 0
            for p, base, docs, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                raw = blob.as_buffer()
                if p != now:
                    now, held, table = p, [], None
                if base < 0:
                    k = raw.size // 16
                    held.append((np.frombuffer(raw, np.uint64, k).copy(), np.frombuffer(raw, np.float64, k, 8 * k).copy()))
                    continue
                if table is None:
                    keys, value = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.uint64), np.empty(0))
                    # an n-gram can have a value of its own and one as a context
                    keys, value = summed(keys, value)
                    table, held = (Index(keys), value), []
                number = numbers(docs)
                k = raw.size // (8 + number().itemsize)
                at, have = table[0].find(np.frombuffer(raw, np.uint64, k))
                if have.any():
                    out.append((base, np.bincount(np.frombuffer(raw, number, k, 8 * k)[have], table[1][at[have]], docs).tobytes()))
                    size += 8 * docs
                    if size > BATCH:
                        yield told(out)
                        out, size = [], 0
            if out:
                yield told(out)

    def added(batches):
        now, total = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array(np.arange(now, now + len(total))), pa.array(total)], ["_row", "far"])
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(blob.as_buffer(), np.float64)
                if base == now:
                    total = total + more
                else:
                    if now is not None:
                        yield told()
                    now, total = base, more
        if now is not None:
            yield told()

    schema = "p bigint, base bigint, docs bigint, blob binary"
    here = reduce(DataFrame.union, values).where(F.shiftrightunsigned("key", 20) % PARTS == part)
    both = map_arrow(here.select("key", "value"), tables, schema).union(map_arrow(texts.select("_row", "text"), asked, schema))
    answers = map_arrow(both.repartition(parts, "p").sortWithinPartitions("p", "base"), answered, "base bigint, blob binary")
    return map_arrow(answers.repartition(parts, "base").sortWithinPartitions("base"), added, "_row bigint, far double")


def runs(rows: np.ndarray, texts: pa.Array):
    """Pieces of a column of texts, cut also where the rows' numbers don't follow each other."""
    cuts = np.flatnonzero(np.diff(rows) != 1) + 1
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
        for a, b, part in pieces(texts.slice(x, y - x), 2 << 20):
            yield x + a, x + b, part


def score(docs: DataFrame, tree: Tree, tables: tuple[DataFrame, list[DataFrame]]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of rows with _row (as `with_numbers` gives it), doc_id, held_out, text."""
    counts, far = tables
    spark = docs.sparkSession
    tree.ready()
    hold = spark.sparkContext.broadcast(tree)

    def lists(keys, of, n_texts):
        """The distinct keys of each text, and how often it has them; of: the text of each key."""
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        flat = pa.StructArray.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(np.diff(np.append(at, len(keys))).astype(np.int32))], ["h", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(n_texts + 1)).astype(np.int32)), flat)

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.column("text")):
                t = hold.value
                tokens, bounds = tokens_of(texts)
                place, known = t.places.find(tokens)
                lp = np.zeros(len(tokens))
                if known.any():
                    lp[known] = t.own[place[known]]
                lp[bounds[:-1]] += t.opening
                for (_, _, key, ok), tables in zip(grams(tokens, bounds, len(t.levels)), t.levels, strict=True):
                    for index, values in filter(None, tables):
                        at, have = index.find(key)
                        have &= ok
                        lp[have] += values[at[have]]
                of = np.repeat(np.arange(b - a), np.diff(bounds))
                base = np.bincount(of[known], t.base[place[known]], b - a) if known.any() else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, b - a) for c in ("_row", "doc_id", "held_out")],
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(np.bincount(of[known], minlength=b - a).astype(np.int64)),
                        pa.array(base),
                        pa.array(np.bincount(of, lp, b - a)),
                        lists(tokens[~known], of[~known], b - a),
                    ],
                    ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "rare"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = durable(map_arrow(docs.select("_row", "doc_id", "held_out", "text"), run, f"_row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, lp double, rare array<struct<h:bigint,n:int>>"))
    n, v = tree.n, tree.v
    # a word that no table knows counts alike wherever it stands, so those that stand often aren't gathered: parts of documents, then sums
    asked = rows.select("_row", F.explode("rare").alias("r")).select("_row", F.col("r.h").alias("h"), F.col("r.n").alias("m"))
    told = asked.join(counts.where(F.col("n") < FREQUENT * n), "h", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    # with nothing learned there is one event
    root = F.log10(F.when(F.col("c") > 0, (F.col("c") + 1) * F.lit(n / (n + v) ** 2)).otherwise(F.lit(v / (n + v)))) if n else F.lit(0.0)
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    sums = told.groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"), F.sum(F.col("m") * base).alias("b"), F.sum(F.col("m") * (root + F.coalesce("value", F.lit(0.0)))).alias("s")
    )
    out = durable(rows.drop("rare").join(sums, "_row", "left"))
    release(rows)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if far:
        collect_garbage(spark)
        slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(t.count() for t in far) // PARTS // SLICE)
        hold.unpersist()
        # the filter alone, since the tree would stand in each worker beside its slice
        tail, more = spark.sparkContext.broadcast(tree.tail), []
        for part in range(PARTS):
            more.append(durable(looked_up(docs, tail, len(tree.next), far, part, slices)))
            collect_garbage(spark)
        whole = more[0]
        for m in more[1:]:
            whole = whole.union(m)
        out = out.join(whole.groupBy("_row").agg(F.sum("far").alias("far")), "_row", "left").withColumn("lp", F.col("lp") + zero("far"))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"),
        (F.col("lp") + zero("s")).alias("score"),
    )


def with_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, text and _row, a number that a row keeps in each reading, however its files are split then; rows of a file are numbered on from a hash of its path.

    What isn't a scan of files that knows places in them is written down first. Hashes whose files' numbers would overlap are given up for others.
    """
    rows = docs.select("doc_id", "text")
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        placed = rows.select("*", *at) if only_scan(rows) else durable(rows).select("*", *at)
    except AnalysisException:
        placed = durable(rows).select("*", *at)
    # a row for each file
    files = durable(placed.groupBy("_file").agg(F.max("_at").alias("_last")))
    for seed in itertools.count():
        first = F.xxhash64(F.lit(seed), "_file").bitwiseAND(F.lit((1 << 62) - 1))
        following = F.lead("h").over(Window.orderBy("h"))
        if files.select(first.alias("h"), "_last").withColumn("next", following).where(F.col("next") <= F.col("h") + F.col("_last")).isEmpty():
            release(files)
            return placed.select("doc_id", "text", (first + F.col("_at")).alias("_row"))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, most: int = BATCH):
    """Batches that go to Python have about `most` bytes at most inside; rows are arrays here, so that their number bounds nothing."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """Scores of all documents, learned from those that aren't held out."""
    with scratch() as keep, bounded_batches(docs.sparkSession):
        rows = with_numbers(docs).select("_row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
        tree, tables = train(rows.where(~F.col("held_out")).select("text"), **options)
        return keep(durable(score(rows, tree, tables)))
