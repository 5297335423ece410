"""Text templates by domain, from YAML files or given tables, checked on the driver; they are a few dozen rows.

The files of the four domains that come with the package are in `SHIPPED`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.schema import DOMAINS, LABELS, RISKS
from larkspan.sources.cluster import exists
from larkspan.sources.journal import names

SCHEMA = "domain_idx bigint, domain string, pattern_idx bigint, n_patterns bigint, n_domains bigint, text_template string, labels array<string>, risk string, rationale_template string"


def checked(data: object, name: str) -> tuple[str, list[dict]]:
    if not isinstance(data, dict) or "domain" not in data:
        raise ValueError(f"{name}: no domain")
    if data["domain"] not in DOMAINS:
        raise ValueError(f"{name}: unknown domain {data['domain']!r}")
    if not data.get("patterns"):
        raise ValueError(f"{name}: no patterns")
    for i, p in enumerate(data["patterns"]):
        for needed in ("text", "risk", "labels"):
            if not p.get(needed) and not (needed == "text" and "text" in p):
                raise ValueError(f"{name}: pattern {i} has no {needed}")
        if bad := [x for x in p["labels"] if x not in LABELS]:
            raise ValueError(f"{name}: pattern {i} has unknown labels {bad}")
        if p["risk"] not in RISKS:
            raise ValueError(f"{name}: pattern {i} has unknown risk {p['risk']!r}")
    return data["domain"], data["patterns"]


def template_table(spark: SparkSession, files: list[tuple[str, object]]) -> DataFrame:
    """A row for each pattern; files (name, parsed data) in order of their names give the order of domains."""
    parsed = [checked(d, n) for n, d in sorted(files, key=lambda f: f[0])]
    if not parsed:
        raise ValueError("no template files")
    rows = [(i, dom, k, len(ps), len(parsed), p["text"], sorted(set(p["labels"])), p["risk"], p.get("rationale_template", "")) for i, (dom, ps) in enumerate(parsed) for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


#: The folder of the package's own files, on the driver.
SHIPPED = Path(__file__).resolve().parent.parent / "templates"


def read_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Names and contents of the YAML files in a folder, under any path that Spark reads, in order of their names."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    if not any(n.endswith(".yaml") for n in names(spark, folder)):
        return []
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return sorted((r["name"], bytes(r["content"]).decode("utf-8")) for r in rows.collect())  # a file for each domain


def parsed(text: str) -> object:
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not YAML: {e}") from e


def load_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The patterns of all files; the first defect raises ValueError."""
    return template_table(spark, [(n, parsed(t)) for n, t in read_files(spark, folder)])


def shipped_templates(spark: SparkSession) -> DataFrame:
    return template_table(spark, [(f.name, parsed(f.read_text(encoding="utf-8"))) for f in SHIPPED.glob("*.yaml")])


def template_defects(spark: SparkSession, folder: str, known_slots: Sequence[str] = ()) -> DataFrame:
    """file and defect: what keeps files from being loaded, and slots of patterns that nothing fills, if the known ones are given."""
    found = []
    for name, text in read_files(spark, folder):
        try:
            _, patterns = checked(parsed(text), name)
        except ValueError as e:
            found.append((name, str(e)))
            continue
        for i, p in enumerate(patterns):
            slots = re.findall(r"\{(\w+)\}", f"{p['text']} {p.get('rationale_template', '')}")
            found += [(name, f"{name}: pattern {i} has an unknown slot {s}") for s in sorted(set(slots) - set(known_slots)) if known_slots]
    return spark.createDataFrame(found, "file string, defect string")


def label_support(templates: DataFrame) -> DataFrame:
    return templates.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("patterns"))


def missing_labels(rows: DataFrame, wanted: Sequence[str], *by: str) -> DataFrame:
    """by and missing: the wanted labels that no row (labels) of a group has, in order. A group gathers no more than each label once."""
    have = rows.select(*by, F.explode_outer("labels").alias("label")).groupBy(*by).agg(F.collect_set("label").alias("have"))
    return have.select(*by, F.array_sort(F.array_except(F.array(*[F.lit(x) for x in wanted]), "have")).alias("missing"))
