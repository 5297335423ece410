"""Subword tokenizers from vocabulary files, as functions of a column that run in Arrow batches.

A file is read by Spark, from any path that Spark reads, and broadcast (a vocabulary has a fixed size); a Python worker builds its tokenizer once. Strings of special
tokens in a text are ordinary text. Null texts are empty. What a tokenizer makes of a text is a hundred times as large as its subwords, so a batch goes through it
in slices of bounded size and only the numbers are kept, as Arrow arrays. Each call of a function has a Python worker of its own in each task, with a tokenizer;
what takes several, `counted` does in one, and only counts leave it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.prompts import MAX_TOKENS, framed
from larkspan.sources.cluster import map_arrow, send_code

_built: dict = {}
#: Bytes of texts that a tokenizer has at once, or of one text; four count for a subword.
SLICE = 1 << 18
IDS = pa.list_(pa.int32())


def built(data: bytes):
    """The tokenizer of a file's content; one for each process."""
    key = hashlib.sha256(data).digest()
    if key not in _built:
        # a task has one core; threads would each have memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(data.decode("utf-8"))
        made.encode_special_tokens = True
        _built[key] = made
    return _built[key]


def slices(values: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """Values in order, in slices of at most SLICE bytes or of one value."""
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield values.slice(at, to - at)
        at = to


def _encoded(tokenizer, texts: pa.Array) -> pa.Array:
    found = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))


def _decoded(tokenizer, ids: pa.Array) -> pa.Array:
    return pa.array(tokenizer.decode_batch([i or [] for i in ids.to_pylist()], skip_special_tokens=False), pa.string())


def _content(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def _counts(tokenizer, texts: list[str], frame: list[int], limit: int) -> list[tuple]:
    """Of each text: how many subwords it has, whether it comes back from them, and how many the prompt has that `prompts.assembled` makes."""
    room = max(limit - len(frame), 0)
    ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    back = tokenizer.decode_batch(ids, skip_special_tokens=False)
    if not room:
        sizes = [min(len(frame), limit)] * len(texts)
    else:
        long = [i for i, x in enumerate(ids) if len(x) > room]
        fitted = list(back)
        for i, t in zip(long, tokenizer.decode_batch([ids[i][:room] for i in long], skip_special_tokens=False), strict=True):
            fitted[i] = t
        sizes = [min(len(e.ids), limit) for e in tokenizer.encode_batch_fast([framed(t) for t in fitted], add_special_tokens=False)]
    return [(len(x), b == t, n) for x, b, t, n in zip(ids, back, texts, sizes, strict=True)]


def counted(docs: DataFrame, key: str, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """key, n_subwords, same and n_prompt of docs of key and text, by the tokenizer file at a path: one worker in a task, which holds one slice's subwords at a time."""
    hold = _content(docs.sparkSession, path)

    def run(batches):
        tokenizer = built(hold.value)
        frame = tokenizer.encode(framed(""), add_special_tokens=False).ids
        for batch in batches:
            texts = batch.column(1)
            made = [c for part in slices(texts, pc.fill_null(pc.binary_length(texts), 0)) for c in _counts(tokenizer, [t or "" for t in part.to_pylist()], frame, limit)]
            n, same, m = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.bool_()), pa.array(m, pa.int64())], [key, "n_subwords", "same", "n_prompt"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, "text"), run, f"`{key}` {kind}, n_subwords bigint, same boolean, n_prompt bigint")


def subwords(spark: SparkSession, path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """encode (text to array<int>) and decode (back to text) of the tokenizer file at a path. FileNotFoundError-like failures are Spark's."""
    send_code(spark)
    hold = _content(spark, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [_encoded(built(hold.value), part) for part in slices(texts, pc.fill_null(pc.binary_length(texts), 0))]
            yield pa.concat_arrays(made) if made else pa.array([], IDS)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            made = [_decoded(built(hold.value), part) for part in slices(ids, pc.multiply(pc.fill_null(pc.list_value_length(ids), 0), 4))]
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())

    return encode, decode
