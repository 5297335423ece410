"""Secret scan with multipart linking.

A credential has parts: an access identifier, a secret, an endpoint. Patterns of well-known form (`BASE`)
are reported as they are. Patterns that alone would report far too much (`WEAK`: any assigned user name,
any long mixed token, any URL) are candidates, reported only if complementary parts stand within
`scope` code points: an identifier beside a secret, a secret beside an identifier, an endpoint beside both.
Parts are linked by an interval join: each covers buckets of the width of the scope, parts of
one document that share a bucket meet, and their distance decides.

Native. Texts are scanned once, spans are written down, and only spans of documents with weak candidates
are joined. Parts don't overlap within a kind, so the pairs of a scope are bounded by its width.

Defined cases: a null text is empty; rows are told apart by a generated number, so null, tied and
repeated ids don't mix; an empty table gives none; the work on a long text grows in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, matches

#: The patterns of the contract. Kinds in listed order; a match is kept if its tested part is long enough.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": (ASSIGN, "secret", 8), "access": (ACCESS, "identifier", 16), "hex": (HEX, "secret", 32)}
#: Weak kinds: pattern and role.
WEAK = {
    "weak_identifier": (r"(?i:(access_?key(?:_?id)?|client_?id|user(?:name)?|login|account))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}", "identifier"),
    "weak_secret": (r"(?:(?<![A-Za-z0-9+/])|\G)(?=[A-Za-z+/]*+[0-9])(?=[0-9A-Z+/]*+[a-z])(?=[0-9a-z+/]*+[A-Z])[A-Za-z0-9+/]{20,}+", "secret"),
    "endpoint": (r"(?:https?|jdbc:[a-z]++|redis|amqp|mongodb)://[^\x20\x09-\x0D\"'<>]++", "endpoint"),
}
KINDS = [*BASE, *WEAK]


def spans_sql(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans that are sorted."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    return F.array_sort(spans)


def _found(text: Column, kind: str, pattern: str, keep) -> Column:
    """Matches as structs that sort by start, then by kind as listed. The longest runs are told by a cheap test first."""
    spans = F.filter(matches(text, pattern), keep)
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _base(text: Column, kind: str) -> Column:
    pattern, _, least = BASE[kind]
    if kind == "assign":
        return _found(text, kind, pattern, lambda m: F.length(F.regexp_extract(m["value"], pattern, 2)) >= least)
    # a run of one class: the runs that are too short can as well not match
    return _found(text, kind, pattern[:-1] + f"{{{least - (4 if kind == 'access' else 0)},}}", lambda m: F.lit(True))


def scan(docs: DataFrame) -> DataFrame:
    """_row, doc_id, base and weak: sorted arrays of spans; weak ones that overlap a base span are left out."""
    text = F.coalesce("text", F.lit(""))
    base = in_order(F.concat(*[_base(text, k) for k in BASE]))
    weak = in_order(F.concat(*[_found(text, k, WEAK[k][0], lambda m: F.lit(True)) for k in WEAK]))
    found = docs.select("doc_id", base.alias("base"), weak.alias("weak"))
    clear = F.when(F.size("weak") > 0, F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))).otherwise(F.col("weak"))
    return durable(found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "base", clear.alias("weak")))


def link(scanned: DataFrame, scope: int = 200) -> DataFrame:
    """_row and confirmed: the weak spans that complementary parts stand beside, sorted."""
    role = F.create_map(*[F.lit(x) for k in KINDS for x in (k, (BASE.get(k) or WEAK[k])[1])])
    parts = (
        scanned.where(F.size("weak") > 0)
        .select("_row", F.explode(F.concat("base", "weak")).alias("s"))
        .select("_row", "s.*", role[F.col("s.kind")].alias("role"))
        .withColumn("bucket", F.explode(F.expr(f"sequence(start div {scope}, (end + {scope}) div {scope})")))
    )
    other = parts.select(F.col("_row").alias("o_row"), F.col("bucket").alias("o_bucket"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"))
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    near = parts.where(F.col("rank") >= len(BASE)).join(other, (F.col("_row") == F.col("o_row")) & (F.col("bucket") == F.col("o_bucket")) & (gap <= scope) & (F.col("role") != F.col("o_role")))
    beside = near.groupBy("_row", "start", "rank", "end", "kind", "role").agg(*[F.bool_or(F.col("o_role") == r).alias(r) for r in ("identifier", "secret")])
    wanted = F.when(F.col("role") == "identifier", F.col("secret")).when(F.col("role") == "secret", F.col("identifier")).otherwise(F.col("secret") & F.col("identifier"))
    return beside.where(wanted).groupBy("_row").agg(in_order(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("confirmed"))


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, base and spans: what the base patterns find, and that with the confirmed weak candidates."""
    scanned = scan(docs)
    out = scanned.join(link(scanned, scope), "_row", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return out.select("doc_id", "base", in_order(F.concat("base", F.coalesce("confirmed", none))).alias("spans"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
