"""Language identification by n-gram filters of language bitmasks.

For each language, character n-grams that are frequent in it (`least` of its n-grams, and `ratio` of the
share that they have where they are most frequent) go into one bit-sliced Bloom filter: a slot
holds a bit for each language, an n-gram sets its language's bit in `HASHES` slots, and the AND of an n-gram's slots
is the bitmask of all languages that contain it. A document counts, for each language, the n-grams whose
mask has its bit; a language whose slots are filled to the share f also gets f^HASHES of all other n-grams, which
is subtracted. The largest corrected count decides.

Numpy on Arrow batches, in bounded chunks. The filter has a fixed size, `SLOTS` words for each 64 languages, and is
broadcast; it is gathered by slot, not by n-gram. Training reads about `sample` labelled rows of each language, the
documented bound, picked by a hash of their ids; a language's rows are all read if it has fewer.

Letters are lower-cased; runs of other characters are one boundary. Defined cases: texts that are null or
without letters are `und`, score 0; texts whose n-grams are all unknown get the language with the most training rows,
score 0; ties go to the first language in order; repeated rows agree; without labelled rows all are `und`;
other columns are ignored, in `keep_identified` they come along unchanged, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.llm.arrays import Counter, chunks, mix
from larkspan.llm.common import durable, fresh, map_arrow, scratch

N, HASHES, SLOTS = 4, 3, 1 << 20
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

_letters: list = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of letters with 0 for each run of others and around each text, and the text that each belongs to."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"\n{t}\n\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) + 3 for t in low], np.int64)
    ends = np.cumsum(n)
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for at in (ends - n, ends - 2, ends - 1):
        keep[at] = True
    return np.where(letter, codes, 0)[keep].astype(np.uint64), np.repeat(np.arange(len(texts)), n)[keep]


def grams(codes: np.ndarray, of: np.ndarray, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of each text, and the text, in blocks."""
    for at in range(0, max(0, len(codes) - N + 1), block):
        end = min(at + block, len(codes) - N + 1)
        h = sum((codes[at + k : end + k] + np.uint64(1)) * _FACTORS[k] for k in range(N))
        inside = (of[at:end] == of[at + N - 1 : end + N - 1]) & ((codes[at:end] | codes[at + 1 : end + 1] | codes[at + 2 : end + 2]) > 0)
        yield mix(h[inside]), of[at:end][inside]


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Model:
    """languages in order; masks uint64[words, SLOTS]; the language of most training rows."""

    def __init__(self, languages: list[str], masks: np.ndarray, usual: int):
        self.languages, self.masks, self.usual = languages, masks, usual
        bit = lambda i: (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        self.false = np.array([float(bit(i).mean()) ** HASHES for i in range(len(languages))])

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Languages and scores; the score is the decided language's share of all corrected counts."""
        out, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return out, scores
        for a, b in chunks(texts, 1 << 18):
            rows = [i for i in range(a, b) if texts[i]]
            codes, of = streams([texts[i] for i in rows])
            counts, n = np.zeros((len(self.languages), len(rows))), np.zeros(len(rows))
            for h, doc in grams(codes, of):
                at = slots(h)
                n += np.bincount(doc, minlength=len(rows))
                for w in range(len(self.masks)):
                    both = self.masks[w][at[0]]
                    for s in at[1:]:
                        both = both & self.masks[w][s]
                    for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                        counts[i] += np.bincount(doc, (both >> np.uint64(i % 64)) & np.uint64(1), len(rows))
            has = np.bincount(of, codes > 0, len(rows)) > 0
            sure = np.maximum(0.0, (counts - n * self.false[:, None]) / (1 - self.false[:, None] + 1e-12))
            best, whole = sure.argmax(0), sure.sum(0)
            for j, i in enumerate(rows):
                if has[j]:
                    known = whole[j] > 0
                    out[i] = self.languages[best[j] if known else self.usual]
                    scores[i] = min(1.0, sure[best[j], j] / whole[j]) if known else 0.0
        return out, scores


def train(labelled: DataFrame, sample: int = 4000, least: float = 1e-5, ratio: float = 0.25) -> Model:
    """labelled: doc_id, text, lang; rows without lang are left out."""
    with scratch():
        return _train(labelled, sample, least, ratio)


def _train(labelled: DataFrame, sample: int, least: float, ratio: float) -> Model:
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row per language, and languages are few: a mask holds a bit for each
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Model([], np.zeros((1, SLOTS), np.uint64), 0)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / have[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    picked = rows.where(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("i"), "text")

    def count(batches):
        kept = [Counter(400_000) for _ in languages]
        send = lambda i, kn: pa.RecordBatch.from_arrays([pa.array(np.full(len(kn[0]), i, np.int32)), pa.array(kn[0].view(np.int64)), pa.array(kn[1].astype(np.int64))], ["i", "h", "n"])
        for batch in batches:
            which, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in set(which.tolist()):
                own = [t for t, k in zip(texts, which, strict=True) if k == i and t]
                for a, b in chunks(own, 1 << 18):
                    for h, _ in grams(*streams(own[a:b])):
                        for kn in kept[i].add(h):
                            yield send(i, kn)
        for i, c in enumerate(kept):
            for kn in c.rest():
                yield send(i, kn)

    counts = map_arrow(picked, count, "i int, h bigint, n bigint").groupBy("i", "h").agg(F.sum("n").alias("n"))
    counts = durable(counts)
    totals = counts.groupBy("i").agg(F.sum("n").alias("all"))
    # a row per language
    shares = counts.join(F.broadcast(totals), "i").select("i", "h", (F.col("n") / F.col("all")).alias("p"))
    top = shares.where(F.col("p") >= least).groupBy("h").agg(F.max("p").alias("top"), F.collect_list(F.struct("i", "p")).alias("all"))
    kept = top.select("h", F.explode("all").alias("x"), "top").where(F.col("x.p") >= ratio * F.col("top")).select("h", F.col("x.i").alias("i"))
    bits = kept.select((F.col("i") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, i % 64)").alias("bit"), F.explode(F.array(*[F.expr(f"shiftrightunsigned(h, {20 * k}) & {SLOTS - 1}") for k in range(HASHES)])).alias("slot"))
    masks = np.zeros(((len(languages) + 63) // 64, SLOTS), np.uint64)
    # at most SLOTS rows for each 64 languages
    for batch in [bits.groupBy("w", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()]:
        masks[batch.column("w").to_numpy(), batch.column("slot").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    usual = max(range(len(languages)), key=lambda i: (have[languages[i]], -i))
    return Model(languages, masks, usual)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the columns lang and score, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                found, scores = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores)], [*part.schema.names, lang, score])

    return map_arrow(docs, run, schema)


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows that aren't held out, told from texts only."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **options)
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language can be told, with all their columns as they are, also such as are named like the results."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **options)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return identify(docs, model, lang, score).where(F.col(lang) != UNDETERMINED).drop(lang, score)
