"""A recogniser of people, organisations, places and dates: an averaged perceptron over tags of tokens, trained on filled templates.

Labels come from provenance: a template's filled slot is an entity of its slot's kind, everything else is none, so no list of names is consulted when a
text is read. Training is iterative parameter mixing: in each epoch every shard of the sentences goes on from the common weights by itself, and what it has
changed is averaged over the shards. Changes are whole numbers and shards are sorted, so a retried task gives the same weights. Features are hashed into a
fixed number of places, which bounds what is broadcast and gathered. A sentence's tags are the best sequence under weights and transitions (Viterbi).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.features import ENTITIES
from larkspan.operators.templates import traced
from larkspan.sources.cluster import map_arrow, send_code

#: Which slots hold entities of which kind.
KIND_OF = {
    **dict.fromkeys(("NAME", "FIRST_NAME"), "PERSON"),
    **dict.fromkeys(("HOSPITAL", "CLINIC", "SCHOOL", "COMPANY"), "ORG"),
    **dict.fromkeys(("CITY", "STATE", "NEIGHBORHOOD"), "GPE"),
    **dict.fromkeys(("DAY_OF_WEEK", "MONTH", "TIME"), "DATE"),
}
TAGS = ("", *ENTITIES)
#: Places that features are hashed into, epochs, and rows of a shard at most.
PLACES, EPOCHS, SHARD = 1 << 17, 6, 20_000
#: Tokens that are read together, or one text's last sentence beyond; words and names that a process remembers at most.
TOKENS, KNOWN = 1 << 15, 1 << 18
#: What stands before and after a sentence.
EDGES = ("<<", "<", ">", ">>")
TOKEN, END = re.compile(r"\w+|[^\w\s]"), frozenset(".!?")
#: Words whose full stop ends no sentence, so that a name that has one isn't torn.
SHORT = frozenset(("st", "mt", "ft", "dr", "mr", "mrs", "ms", "prof"))


def sentences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Begins and ends of the tokens of each sentence."""
    now: list[tuple[int, int]] = []
    last = ""
    for m in TOKEN.finditer(text):
        now.append(m.span())
        if m.group() in END and not (m.group() == "." and last.lower() in SHORT):
            yield now
            now = []
        last = m.group()
    if now:
        yield now


def shape(word: str) -> str:
    """Kinds of characters, runs of one kind once."""
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


@lru_cache(KNOWN)
def place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % PLACES


@lru_cache(KNOWN)
def of_word(word: str) -> tuple:
    """A word in small letters, its shape, and the places of what it says of itself, of the next token and of the one before."""
    w, form = word.lower(), shape(word)
    return w, form, (place(f"w{w}"), place(f"s{form}"), place(f"p{w[:3]}{form}"), place(f"e{w[-3:]}{form}"), place(f"a{w}"), place(f"b{w}"))


def places_of(words: list[list[str]]) -> np.ndarray:
    """Places of the features of the tokens of some sentences, one after the other: the word, its shape and ends, and its neighbours. Equal words and pairs are looked at once."""
    known = dict(zip(EDGES, range(len(EDGES)), strict=True))
    flat = [i for sentence in words for i in (0, 1, *[known.setdefault((w,), len(known)) for w in sentence], 2, 3)]
    made = [(x, "", (0, 0, 0, 0, place(f"a{x}"), place(f"b{x}"))) for x in EDGES] + [of_word(w) for (w,) in list(known)[len(EDGES) :]]
    low: dict = {}
    forms: dict = {}
    low_of, form_of = (np.array([d.setdefault(m[k], len(d)) for m in made]) for k, d in ((0, low), (1, forms)))
    ids, alone = np.array(flat), np.array([m[2] for m in made])
    at = np.flatnonzero(ids >= len(EDGES))
    words_, shapes = list(low), list(forms)

    def pairs(name: str, a: np.ndarray, b: np.ndarray, left: list, right: list, blank: str) -> np.ndarray:
        keys, back = np.unique(a * len(right) + b, return_inverse=True)
        # a checksum goes on from that of what stands before
        begun, then = [zlib.crc32(f"{name}{x}{blank}".encode("utf-8", "surrogatepass")) for x in left], [x.encode("utf-8", "surrogatepass") for x in right]
        return np.array([zlib.crc32(then[k], begun[i]) for i, k in zip((keys // len(right)).tolist(), (keys % len(right)).tolist(), strict=True)])[back] % PLACES

    w, f = low_of[ids], form_of[ids]
    return np.column_stack(
        [
            alone[ids[at], :4], alone[ids[at - 1], 4], alone[ids[at + 1], 5],
            pairs("c", w[at - 2], w[at - 1], words_, words_, " "), pairs("d", w[at + 1], w[at + 2], words_, words_, " "),
            pairs("f", f[at - 1], f[at], shapes, shapes, ""), pairs("g", f[at], f[at + 1], shapes, shapes, ""), pairs("h", w[at - 1], f[at], words_, shapes, " "),
        ]
    )


def places(words: list[str]) -> np.ndarray:
    return places_of([words])


def best_of(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """`best` of sentences whose tokens follow each other in scores, all of them a token further at a time."""
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    starts, ends = first[order], lengths[order]
    back = np.zeros(scores.shape, np.int8)
    now = scores[starts] + moves[-1]
    # how many sentences have a token at a place: the first ones, since the longest come first
    have = np.searchsorted(-ends, -np.arange(ends[0]), "left")
    for i in range(1, int(ends[0])):
        m = have[i]
        ways = now[:m, :, None] + moves[:-1]
        back[starts[:m] + i] = ways.argmax(1)
        now[:m] = ways.max(1) + scores[starts[:m] + i]
    tags = np.zeros(len(scores), np.int64)
    tag = now.argmax(1)
    for i in range(int(ends[0]) - 1, -1, -1):
        m = have[i]
        tags[starts[:m] + i] = tag[:m]
        if i:
            tag[:m] = back[starts[:m] + i, tag[:m]]
    return [tags[a : a + n] for a, n in zip(first.tolist(), lengths.tolist(), strict=True)]


def best(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The tags with the highest sum of scores (tokens, tags) and moves (from, to; the last row is the start). Ties go to the first tag."""
    back = np.zeros(scores.shape, np.int64)
    now = scores[0] + moves[-1]
    for i in range(1, len(scores)):
        ways = now[:, None] + moves[:-1]
        back[i] = ways.argmax(0)
        now = ways.max(0) + scores[i]
    out = [int(now.argmax())]
    for i in range(len(scores) - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return np.array(out[::-1])


@dataclass
class Recogniser:
    """weights: (PLACES, tags); moves: (tags + 1, tags)."""

    weights: np.ndarray
    moves: np.ndarray

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Begin, end and kind of the entities of a text, in code points; tokens of one kind that follow each other are one."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list) -> list[list[tuple[int, int, str]]]:
        """The spans of each text. Sentences are read together, as many as come to TOKENS."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        held: list[tuple[int, list[tuple[int, int]]]] = []
        words: list[list[str]] = []
        size = 0
        for n, text in enumerate(texts):
            for tokens in sentences(text or ""):
                held.append((n, tokens))
                words.append([text[a:b] for a, b in tokens])
                size += len(tokens)
                if size >= TOKENS:
                    self._mark(held, places_of(words), out)
                    held, words, size = [], [], 0
        if held:
            self._mark(held, places_of(words), out)
        return out

    def _mark(self, held: list, at: np.ndarray, out: list) -> None:
        # the weights of a few thousand tokens at once stay in a processor's cache
        scores = np.concatenate([self.weights[at[i : i + 2048]].sum(1) for i in range(0, len(at), 2048)])
        for (n, tokens), tags in zip(held, best_of(scores, np.array([len(t) for _, t in held]), self.moves), strict=True):
            if not tags.any():
                continue
            last, mine = 0, out[n]
            for (a, b), t in zip(tokens, tags.tolist(), strict=True):
                if t and t == last:
                    mine[-1] = (mine[-1][0], b, mine[-1][2])
                elif t:
                    mine.append((a, b, TAGS[t]))
                last = t

    def found(self, spark: SparkSession):
        """A function from a column of texts to array<struct<start, end, kind>>."""
        send_code(spark)
        hold = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in found] for found in hold.value.spans_of(texts.tolist())], dtype=object)

        return run


def entity_counts(spans: Column) -> dict[str, Column]:
    """By kind how many spans there are, for `functions.features.features`."""
    return {k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint") for k in ENTITIES}


def examples(rows: DataFrame, templates: DataFrame, seed: object) -> DataFrame:
    """row and pieces (text and kind) of filled templates, for rows (row, whole numbers from 0): each takes a template in turn."""
    n = templates.count()
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    # templates are a few dozen
    numbered = templates.select("text_template", (F.row_number().over(Window.orderBy("domain_idx", "pattern_idx")) - 1).cast("long").alias("_t"))
    cyc = rows.join(F.broadcast(numbered), F.col("row") % n == F.col("_t"))
    pieces = F.transform(traced(F.col("text_template"), seed, F.col("row")), lambda p: F.struct(p["text"].alias("text"), F.try_element_at(kinds, p["slot"]).alias("kind")))
    return cyc.select("row", pieces.alias("pieces"))


def sentences_of(pieces: list[dict]) -> Iterator[tuple[list[str], list[int]]]:
    """Words and tags of each sentence of an example."""
    text, marks = "", []
    for p in pieces:
        if p["kind"]:
            marks.append((len(text), len(text) + len(p["text"]), TAGS.index(p["kind"])))
        text += p["text"]
    for tokens in sentences(text):
        yield [text[a:b] for a, b in tokens], [next((k for x, y, k in marks if x <= a and b <= y), 0) for a, b in tokens]


def epoch(model: Recogniser, shard: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over a shard's sentences (places, tags) from a model: what changed, as places of weights and amounts, and of moves."""
    weights, moves = model.weights.copy(), model.moves.copy()
    for at, gold in shard:
        got = best(weights[at].sum(1), moves)
        wrong = np.flatnonzero(got != gold)
        if not len(wrong):
            continue
        for i in wrong:
            np.add.at(weights, (at[i], gold[i]), 1)
            np.add.at(weights, (at[i], got[i]), -1)
        start = len(moves) - 1
        np.add.at(moves, (np.concatenate(([start], gold[:-1])), gold), 1)
        np.add.at(moves, (np.concatenate(([start], got[:-1])), got), -1)
    dw, dm = (weights - model.weights).ravel(), (moves - model.moves).ravel()
    w, m = np.flatnonzero(dw), np.flatnonzero(dm)
    return w, dw[w], m, dm[m]


def train(data: DataFrame, epochs: int = EPOCHS) -> Recogniser:
    """From examples (row, pieces). The result is the mean of the weights after each epoch."""
    spark = data.sparkSession
    tags = len(TAGS)
    shards = max(1, -(-data.count() // SHARD))
    data = data.select("row", "pieces").repartition(shards, "row").sortWithinPartitions("row").persist()
    model, total = Recogniser(np.zeros((PLACES, tags)), np.zeros((tags + 1, tags))), None
    for _ in range(epochs):
        hold = spark.sparkContext.broadcast(model)

        def run(batches):
            made = [x for batch in batches for pieces in batch.column(1).to_pylist() for x in sentences_of(pieces)]
            if made:
                at = np.split(places_of([words for words, _ in made]), np.cumsum([len(words) for words, _ in made])[:-1])
                shard = [(x, np.array(gold)) for x, (_, gold) in zip(at, made, strict=True)]
                w, dw, m, dm = epoch(hold.value, shard)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w, m + PLACES * tags])), pa.array(np.concatenate([dw, dm]))], ["at", "change"])

        # as many rows as there are places, at most
        changed = map_arrow(data, run, "at bigint, change double").groupBy("at").agg(F.sum("change").alias("change")).toArrow()
        flat = np.concatenate([model.weights.ravel(), model.moves.ravel()])
        flat[changed.column("at").to_numpy()] += changed.column("change").to_numpy() / shards
        model = Recogniser(flat[: PLACES * tags].reshape(PLACES, tags), flat[PLACES * tags :].reshape(tags + 1, tags))
        total = flat if total is None else total + flat
    data.unpersist()
    mean = total / epochs
    return Recogniser(mean[: PLACES * tags].reshape(PLACES, tags), mean[PLACES * tags :].reshape(tags + 1, tags))


def span_scores(model: Recogniser, data: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of whole spans over examples (row, pieces), by kind."""
    spark = data.sparkSession
    find = model.found(spark)
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("all"))
    gold = F.aggregate(
        "pieces",
        zero,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["text"])).alias("at"),
            F.when(p["kind"].isNotNull(), F.array_append(a["all"], F.struct(a["at"].alias("start"), (a["at"] + F.length(p["text"])).alias("end"), p["kind"].alias("kind")))).otherwise(a["all"]).alias("all"),
        ),
        lambda a: a["all"],
    )
    rows = data.select("row", gold.alias("gold"), find(text).alias("got"))
    marked = rows.select(F.explode(F.concat(F.transform(F.array_intersect("gold", "got"), lambda s: F.struct(s["kind"].alias("kind"), F.lit("tp").alias("of"))), F.transform(F.array_except("got", "gold"), lambda s: F.struct(s["kind"].alias("kind"), F.lit("fp").alias("of"))), F.transform(F.array_except("gold", "got"), lambda s: F.struct(s["kind"].alias("kind"), F.lit("fn").alias("of"))))).alias("m"))
    counts = marked.groupBy(F.col("m.kind").alias("kind")).agg(*[F.count_if(F.col("m.of") == x).alias(x) for x in ("tp", "fp", "fn")])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
