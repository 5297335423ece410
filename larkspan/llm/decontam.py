"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; the tokens under its 1s are hashed, those under its 0s
are ignored, so a hit survives substitutions there, and masks of different shape survive different ones.
Hashes of all positions of benchmark items and documents are joined; a hit gives a document, an item and
the diagonal on which their tokens align. Each diagonal is then verified: it counts the item's tokens that
the document has at the aligned places, whatever substitutions stand between. Matched places of an item
are united over the diagonals of a document, so an insertion or deletion doesn't hide the rest, and a document
is contaminated by an item if the share of matched tokens reaches `overlap`.

Native. The benchmark's seeds are broadcast only if they number at most `BROADCAST_SEEDS`; beyond that
they are joined by shuffle. Hits are narrow: a broadcast's carry the tokens that the item aligns with, as all of a document's hits are in memory
at once; of the others' only documents with hits are read again for verification.

Defined cases: tokens are lower-cased runs of letters and digits; items of fewer tokens than the longest mask
are found by pairs of their tokens and have to reach `overlap` on one diagonal, those below `MIN_TOKENS` match nothing, and so do items without an id;
null texts match nothing; null and repeated ids are found row by row, no item is put together from several rows, and one row is reported for each doc_id
and item; ties between diagonals go to the first place in the document; other columns are ignored, in `decontaminate` they come along, whatever
their names; long texts are read whole; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, fresh, scratch, with_rows

#: Each has its first and fourth token: that pair, which is cheap to test, is looked up before the masks are.
MASKS = ("11011011", "1011010011", "1101001101")
PAIR = 3
MIN_TOKENS = 4
BROADCAST_SEEDS = 2_000_000
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the tokens: array<bigint>."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(token, masks: dict[int, str]) -> Column:
    """token(k): the token k places on. masks: by number, so that masks don't mix."""
    one = lambda n, m: F.when(token(len(m) - 1).isNotNull(), F.xxhash64(F.lit(n), *[token(k) for k, c in enumerate(m) if c == "1"]))
    return F.array(*[one(n, m) for n, m in masks.items()])


def seeds(df: DataFrame, masks: dict[int, str]) -> DataFrame:
    """`id`, pos, h: a row for each mask and position of the tokens `t`; each position carries the tokens that it needs."""
    span = max(map(len, masks.values()))
    shifted = F.arrays_zip(*[F.slice("t", k + 1, F.greatest(F.size("t"), F.lit(1))).alias(f"t{k}") for k in range(span)])
    rows = df.select("id", F.posexplode(shifted).alias("pos", "w"))
    return rows.select("id", "pos", F.explode(_hashes(lambda k: F.col(f"w.t{k}"), masks)).alias("h")).where(F.col("h").isNotNull())


def seeds_near(df: DataFrame, masks: dict[int, str], pairs: DataFrame) -> DataFrame:
    """The same, with `t`, where `pairs` (p), which is broadcast, has the position's pair. No exchange comes between, so positions share their document's tokens."""
    at = lambda k: F.get("t", F.col("pos") + k)
    rows = df.select("id", "t", F.posexplode("t").alias("pos", "t0")).withColumn("p", F.xxhash64("t0", at(PAIR)))
    rows = rows.join(F.broadcast(pairs), "p", "left_semi")
    return rows.select("id", "t", "pos", F.explode(_hashes(lambda k: at(k) if k else F.col("t0"), masks)).alias("h")).where(F.col("h").isNotNull())


def short_seeds(items: DataFrame, overlap: float) -> DataFrame:
    """item, item_pos, gap, item_h of short items: each pair of tokens that can be the first two matched ones on a diagonal that reaches `overlap`."""
    free = F.size("t") - F.greatest(F.lit(2), F.ceil(F.size("t") * overlap - 1e-9).cast("int"))
    first = items.select("id", "t", free.alias("free"), F.posexplode("t").alias("pos", "t0")).where(F.col("pos") <= F.col("free"))
    pairs = first.withColumn("gap", F.explode(F.sequence(F.lit(1), F.col("free") + 1 - F.col("pos"))))
    return pairs.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "gap", F.xxhash64("gap", "t0", F.get("t", F.col("pos") + F.col("gap"))).alias("item_h"))


def hits(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.6, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """id, items (ids of equal ones), matched, n, doc_start from docs of id, unique, and text. Lazy; its tables belong to the scope around."""
    longest = max(map(len, masks))
    items = durable(
        benchmark.select("item_id", tokens(F.col("text")).alias("t"))
        .where((F.size("t") >= MIN_TOKENS) & F.col("item_id").isNotNull())
        .groupBy("t")
        .agg(F.min("item_id").alias("id"), F.collect_set("item_id").alias("items"))
    )
    long, short = items.where(F.size("t") >= longest), items.where(F.size("t") < longest)
    wide = dict(enumerate(masks))
    keys = seeds(long, wide)
    keys = durable(keys.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("h").alias("item_h")))
    short_keys = durable(short_seeds(short, overlap))
    # with how many tokens the item has
    sized = lambda k: F.broadcast(k.join(items.select(F.col("id").alias("item"), F.size("t").alias("n")), "item"))
    gaps = short_keys.agg(F.max("gap")).first()[0] or 0
    few = keys.count() + short_keys.count() <= BROADCAST_SEEDS
    read = docs.select("id", tokens(F.col("text")).alias("t"))
    diagonal = (F.col("pos") - F.col("item_pos")).alias("diagonal")
    item_t = items.select(F.col("id").alias("item"), F.col("t").alias("item_t"))
    at = lambda t, first: F.filter(F.transform("item_t", lambda x, i: F.when(F.get(t, i + first) == x, i)), lambda i: i.isNotNull())
    aligned = lambda df, t, first: df.select("id", "item", "diagonal", F.size("item_t").alias("n"), at(t, first).alias("at"))
    window = F.slice("t", F.greatest(F.col("pos") - F.col("item_pos"), F.lit(0)) + 1, F.col("n")).alias("w")
    pair = lambda k: F.xxhash64(F.lit(k), "t0", F.get("t", F.col("pos") + k))
    if few:
        # fewer items than seeds
        pairs = long.select("t", F.posexplode("t").alias("pos", "t0")).select(F.xxhash64("t0", F.get("t", F.col("pos") + PAIR)).alias("p")).distinct()
        found = seeds_near(read, wide, pairs).join(sized(keys), F.col("h") == F.col("item_h")).select("id", window, "item", diagonal)
        if gaps:
            near = read.select("id", "t", F.posexplode("t").alias("pos", "t0")).select("id", "t", "pos", F.explode(F.array(*[pair(k) for k in range(1, gaps + 1)])).alias("h"))
            found = found.union(near.join(sized(short_keys), F.col("h") == F.col("item_h")).select("id", window, "item", diagonal))
        both = aligned(found.join(F.broadcast(item_t), "item"), "w", F.least("diagonal", F.lit(0))).distinct()
    else:
        found = seeds(read, wide).join(keys, F.col("h") == F.col("item_h")).select("id", "item", diagonal)
        if gaps:
            near = read.select("id", "t", F.posexplode("t").alias("pos", "t0")).select("id", "pos", F.explode(F.array(*[pair(k) for k in range(1, gaps + 1)])).alias("h"))
            found = found.union(near.join(short_keys, F.col("h") == F.col("item_h")).select("id", "item", diagonal))
        met = durable(found.distinct())
        held = docs.join(met.select("id").distinct(), "id", "left_semi").select("id", tokens(F.col("text")).alias("t"))
        # a row for each diagonal meets the one row of its document
        both = aligned(met.join(item_t, "item").join(held, "id"), "t", F.col("diagonal"))
    # places of an item are counted as rows, so many diagonals of a repetitive text aren't gathered
    places = (
        both.where((F.col("n") >= longest) | (F.size("at") >= overlap * F.col("n")))
        .select("id", "item", "n", F.greatest("diagonal", F.lit(0)).alias("start"), F.explode("at").alias("place"))
        .groupBy("id", "item", "n", "place")
        .agg(F.min("start").alias("start"))
    )
    whole = places.groupBy("id", "item", "n").agg(F.count("*").alias("matched"), F.min("start").alias("doc_start")).where(F.col("matched") >= overlap * F.col("n"))
    return whole.join(items.select(F.col("id").alias("item"), "items"), "item").select("id", "items", "matched", "n", "doc_start")


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, matched, item_tokens, overlap, doc_start: a row for each doc_id and item that a document of this id holds; of several, that with most matches.

    doc_start is the smallest token position at which a verified diagonal enters the item.
    """
    with scratch() as keep:
        row = fresh(docs, "_row")
        rows = with_rows(docs, row)
        held = durable(hits(rows.select(F.col(row).alias("id"), "text"), benchmark, **options))
        ids = rows.select(F.col(row).alias("id"), "doc_id").join(held.select("id").distinct(), "id", "left_semi")
        one = held.join(ids, "id").select("doc_id", F.explode("items").alias("item_id"), "matched", "n", "doc_start")
        best = F.max(F.struct("matched", (-F.col("doc_start")).alias("s")))
        return keep(
            durable(
                one.groupBy("doc_id", "item_id", "n")
                .agg(best.alias("b"))
                .select(
                    "doc_id",
                    "item_id",
                    F.col("b.matched").cast("long").alias("matched"),
                    F.col("n").cast("long").alias("item_tokens"),
                    F.round(F.col("b.matched") / F.col("n"), 6).alias("overlap"),
                    (-F.col("b.s")).cast("long").alias("doc_start"),
                )
            )
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns; rows are told apart whatever their ids."""
    row = fresh(docs, "_row")
    rows = with_rows(docs, row)
    with scratch() as keep:
        # written, so that its size is known and a small one is broadcast rather than texts shuffled
        bad = keep(durable(hits(rows.select(F.col(row).alias("id"), "text"), benchmark, **options).select(F.col("id").alias(row)).distinct()))
    return rows.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
