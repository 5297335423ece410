"""Personal data, by patterns and by information-theoretic sanitisation.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; their values are the protected
entities. Words beside an entity may reveal it even where it is masked: over the corpus, a term t that
stands in documents with an entity e discloses PMI(t; e) of the IC(e) bits that e holds,

    PMI(t; e) / IC(e) = 1 + log(P(e | t)) / log(N / df(e)), P(e | t) = (df(t, e) + a df(e) / N) / (df(t) + a),

where df counts whole documents with the entity, the term or both, and `smoothing` a draws the estimate
for rare terms to what the entity has anywhere. The ratio is near 1 for a term that occurs with e only, about 0 for one that is
independent of it. Terms at `remove` or above are removed, those from `generalise` up are
generalised, wherever they stand in a document that holds the entity.

Native. Texts are read twice: for spans, which are written down with the texts that have some, and for df(t), a
count with map-side combination. A term can reach `generalise` only up to a df(t) that follows from df(e), so
frequent ones are left out before pairs are made; the pairs of a document are its values times its rarer terms.

Defined cases: a null text is empty; rows are told apart by a generated number, so null, tied and repeated
ids don't mix; an empty table gives none; the work on a long text grows in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, let, matches, total

#: The patterns of the contract, in listed order.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The same matches in time proportional to the text: a match starts where a run starts or the last match
#: ended, and groups that can't gain by giving back don't.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PHONE,
}
KINDS = [*FAST]
TERM = r"[\p{L}\p{N}]+"
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]?[0-9])"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts twice, digits of that added up."""
    one = lambda i: F.substr(d, (F.length(d) - i + 1).cast("int"), F.lit(1)).cast("long")
    twice = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
    return total(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.when(i % 2 == 0, twice(one(i))).otherwise(one(i)))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    return F.transform(
        F.filter(matches(text, FAST[kind]), lambda m: valid(kind, m["value"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")),
    )


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_found(text, k) for k in KINDS]))


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """_row, doc_id, base spans, their entities and the text, which is null without keep_text where no span is."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), base_spans(text).alias("base"))
    name = lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(digits(s["value"])))
    held = found.withColumn("entities", F.array_distinct(F.transform("base", name))).withColumn("_row", F.monotonically_increasing_id())
    return durable(held.select("_row", "doc_id", "base", "entities", (F.col("text") if keep_text else F.when(F.size("base") > 0, F.col("text"))).alias("text")))


def disclosures(docs: DataFrame, scanned: DataFrame, smoothing: float = 1.0, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """_row, start, end, action, ratio: the spans of terms that disclose an entity of their document."""
    held = scanned.where(F.size("base") > 0)
    n = scanned.count()
    mentions = held.select("_row", F.explode("entities").alias("entity"))
    # P(e | t) is at least (N / df_e) ^ (generalise - 1), and at most what df_te = df_e gives
    most = F.col("df_e") * (1 + smoothing / max(n, 1)) * F.pow(F.lit(float(n)) / F.col("df_e"), F.lit(1 - generalise)) - smoothing
    df_e = mentions.groupBy("entity").agg(F.count("*").alias("df_e")).withColumn("most", most + 1e-6)
    mentions = durable(mentions.join(df_e, "entity"))
    reach = mentions.groupBy("_row").agg(F.max("most").alias("most"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))).alias("term"))
    df_t = words.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("df_t"))
    said = held.join(reach, "_row").select("_row", "most", F.explode(matches(F.col("text"), TERM)).alias("w"))
    said = said.select("_row", "most", F.xxhash64(F.lower("w.value")).alias("h"), "w.start", "w.end")
    said = said.join(df_t, "h").where(F.col("df_t") <= F.col("most")).drop("most")
    # a term that belongs to a protected value isn't a term beside it
    spans = held.select("_row", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("base"))
    said = durable(said.join(spans, "_row").where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))).drop("base"))
    pairs = said.select("_row", "h", "df_t").distinct().join(mentions, "_row").where(F.col("df_t") <= F.col("most")).select("_row", "entity", "df_e", "h", "df_t")
    given = (F.col("df_te") + F.lit(smoothing) * F.col("df_e") / n) / (F.col("df_t") + F.lit(smoothing))
    ic = F.log(F.lit(float(n)) / F.col("df_e"))
    rated = pairs.groupBy("entity", "df_e", "h", "df_t").agg(F.count("*").alias("df_te")).withColumn("ratio", F.when(ic > 0, 1 + F.log(given) / ic).otherwise(0.0))
    rated = rated.where(F.col("ratio") >= generalise).select("entity", "h", "ratio")
    best = pairs.join(rated, ["entity", "h"]).groupBy("_row", "h").agg(F.max("ratio").alias("ratio"))
    hits = said.join(best, ["_row", "h"]).select("_row", "start", "end", "ratio")
    return hits.withColumn("action", F.when(F.col("ratio") >= remove, "term_removed").otherwise("term_generalised"))


def find_personal_data(docs: DataFrame, keep_text: bool = False, **thresholds) -> DataFrame:
    """doc_id, base and spans: what patterns find, and that with the disclosing terms that don't overlap it."""
    scanned = scan(docs, keep_text)
    terms = disclosures(docs, scanned, **thresholds)
    added = terms.groupBy("_row").agg(
        F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.col("action").alias("kind"), F.lit("").alias("value"))).alias("added")
    )
    out = scanned.join(added, "_row", "left")
    clear = F.filter("added", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear)))
    return out.select("doc_id", "base", spans.alias("spans"), *(["text"] if keep_text else []))


#: What stands in the place of a span. A removed term leaves nothing.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term_generalised": "[TERM]", "term_removed": ""}


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text with its spans masked; of overlapping spans the first goes, with what it covers."""
    found = find_personal_data(docs, keep_text=True, **options)
    mask = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])
    reach = lambda s, i: F.coalesce(F.array_max(F.transform(F.slice("spans", 1, i), lambda x: x["end"])), F.lit(0).cast("long"))
    pieces = F.transform(
        "spans",
        lambda s, i: F.concat(
            F.substr("text", (reach(s, i) + 1).cast("int"), F.greatest(s["start"] - reach(s, i), F.lit(0)).cast("int")),
            F.when(s["start"] >= reach(s, i), mask[s["kind"]]).otherwise(F.lit("")),
        ),
    )
    tail = F.substr("text", (F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"])), F.lit(0)) + 1).cast("int"), F.length("text"))
    return found.select("doc_id", F.concat(F.array_join(pieces, ""), tail).alias("text"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
