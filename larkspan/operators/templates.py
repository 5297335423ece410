"""Examples from templates: rows meet patterns by cyclic keys, slots are filled by hash.

Row i takes domain i mod D and pattern (i div D) mod P of it. Each occurrence of a slot is filled by itself: the hash of
seed, row, place and slot picks from the slot's values. All native; the pattern table is a few dozen rows and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.scalars import ordinal

SLOT = r"\{(\w+)\}"
#: Values of slots; own inventions. FLOOR, AGE and YEAR are numbers.
VALUES: dict[str, tuple[str, ...]] = {
    "HOSPITAL": ("Northgate Hospital", "St. Brann Hospital", "Willow Vale Hospital"),
    "SPECIALTY": ("cardiology", "oncology", "neurology", "dermatology"),
    "DAY_OF_WEEK": ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"),
    "CLINIC": ("Harbour Clinic", "Elm Row Clinic", "Fernside Clinic"),
    "MEDICATION": ("metformin", "sertraline", "warfarin"),
    "CONDITION": ("asthma", "migraine", "diabetes"),
    "TIME": ("07:15 AM", "12:30 PM", "06:45 PM"),
    "NEIGHBORHOOD": ("Lower Quay", "Maple Terrace", "Old Mill"),
    "CITY": ("Brindale", "Port Lowe", "Kestrel Falls"),
    "LOCATION": ("12 Alder Way", "408 Quarry Road", "7 Lantern Street"),
    "SCHOOL": ("Pell Elementary", "Oakham Elementary"),
    "BUS_ROUTE": ("Route 14", "Route 27", "Route 81"),
    "COMPANY": ("Tarn Logistics", "Hexley Labs", "Corvid Media"),
    "DEPARTMENT": ("accounting", "legal", "logistics"),
    "JOB_TITLE": ("surveyor", "paralegal", "lab manager"),
    "BUILDING": ("31 Tanner Row", "220 Dock Street"),
    "ETHNICITY": ("Basque", "Samoan", "Kurdish"),
    "RELIGION": ("Quaker", "Jain", "Sikh"),
    "DEVICE_MODEL": ("Model A phone", "Model T tablet", "Model W watch"),
    "DEVICE_ID": ("SN-10442087", "SN-55310926", "SN-80019374"),
    "USERNAME": ("otter_lane", "mq.vance", "redfern88"),
    "NAME": ("Ines Abery", "Tomas Quill", "Mara Lindqvist"),
    "FIRST_NAME": ("Ines", "Tomas", "Mara"),
    "FREQUENCY": ("every week", "twice a month", "every morning"),
    "STATE": ("Ohio", "Maine", "Utah"),
    "MONTH": ("January", "April", "July", "October"),
    "PASSWORD_HINT": ("the dog's name and a year", "a street and its number"),
}
NUMBERS = {"FLOOR": (1, 30), "AGE": (18, 75), "YEAR": (1, 30)}


def _draw(n: int, *parts: Column) -> Column:
    """0 .. n-1 from the first 28 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 7), 16, 10).cast("bigint") % n


def slot_values(template: Column, seed: object, row: Column) -> Column:
    """What the template's slots are filled with, in their order; an unknown slot fails."""
    slots = F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))

    def value(slot: Column, place: Column) -> Column:
        draw = lambda n: _draw(n, F.lit(str(seed)), row.cast("string"), place.cast("string"), slot)
        out = None
        for name, values in VALUES.items():
            pick = F.get(F.array(*[F.lit(v) for v in values]), draw(len(values)).cast("int"))
            out = F.when(slot == name, pick) if out is None else out.when(slot == name, pick)
        for name, (lo, hi) in NUMBERS.items():
            n = draw(hi - lo + 1) + lo
            out = out.when(slot == name, ordinal(n) if name == "FLOOR" else n.cast("string"))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown slot "), slot)))

    return F.transform(slots, value)


def fill(template: Column, seed: object, row: Column) -> Column:
    """The template with every {SLOT} replaced."""
    values = slot_values(template, seed, row)
    return F.array_join(F.transform(F.split(template, SLOT, -1), lambda b, i: F.concat(b, F.coalesce(F.get(values, i), F.lit("")))), "")


def traced(template: Column, seed: object, row: Column) -> Column:
    """The pieces of the filled template with the slots they come from (null between slots): array<struct<text, slot>>. Joined, they are what `fill` gives."""
    slots = placeholders(template)
    values = slot_values(template, seed, row)
    piece = lambda t, s: F.struct(t.alias("text"), s.alias("slot"))
    none = F.lit(None).cast("string")
    pairs = F.transform(F.split(template, SLOT, -1), lambda b, i: F.array(piece(b, none), piece(F.coalesce(F.get(values, i), F.lit("")), F.get(slots, i))))
    return F.filter(F.flatten(pairs), lambda p: p["text"] != "")


def generate(spark: SparkSession, templates: DataFrame, count: int, seed: object) -> DataFrame:
    """row and the columns of a raw example."""
    if count <= 0:
        raise ValueError("count must be positive")
    return filled(spark.range(count).select(F.col("id").alias("row")), templates, seed)


def filled(rows: DataFrame, templates: DataFrame, seed: object) -> DataFrame:
    """row and the columns of a raw example, for given rows (row, whole numbers from 0)."""
    domains = templates.agg(F.max("n_domains")).first()[0]
    rows = rows.withColumns({"_d": F.col("row") % domains, "_k": F.expr(f"row div {domains}")})
    # templates are as many rows as the files have patterns
    cyc = rows.join(F.broadcast(templates), (F.col("_d") == F.col("domain_idx")) & (F.col("_k") % F.col("n_patterns") == F.col("pattern_idx")))
    return cyc.select("row", fill(F.col("text_template"), seed, F.col("row")).alias("text"), "labels", "risk", F.when(F.col("risk") == "LOW", "").otherwise(fill(F.col("rationale_template"), f"{seed}-r", F.col("row"))).alias("rationale"), F.lit(False).alias("is_hard_negative"), "domain", F.lit("template").alias("source"))


def placeholders(pattern: Column) -> Column:
    """The names of a pattern's slots in their order, repeated ones too."""
    return F.regexp_extract_all(pattern, F.lit(SLOT), F.lit(1))
