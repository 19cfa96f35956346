"""Deck records and labels from JSON files, as tables.

A deck record is one JSON object with a deck's slides, objects, assets,
relationships and evidence. Fields that the tables don't name stay in the
record's text (``raw``). A file that breaks the contract gives a reason, never a
failed job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "bbox:array<double>"
EVIDENCE = f"array<struct<id:string,slide_id:string,object_id:string,status:string,confidence:double,{_BOX},value:string>>"
RECORD = (
    "struct<schema_version:string,deck:struct<name:string,source_format:string,sha256:string,slide_count:int,slide_size_emu:array<bigint>>,"
    "slides:array<struct<id:string,number:int,part:string,text:array<string>,notes:array<string>,hyperlinks:array<struct<target:string,resolved_target:string,mode:string>>>>,"
    f"objects:array<struct<id:string,slide_id:string,parent_id:string,type:string,name:string,text:string,{_BOX},z_order:int,asset_id:string,native_id:string>>,"
    "assets:array<struct<id:string,part:string,content_type:string,sha256:string,size:bigint>>,relationships:array<struct<id:string,source_part:string,target:string,target_mode:string,resolved_target:string>>,"
    f"rendered_evidence:{EVIDENCE},ocr_evidence:{EVIDENCE},vision_evidence:{EVIDENCE},warnings:array<string>>"
)
LABELS = (
    "struct<text:array<string>,objects:array<struct<id:string,slide_id:string,type:string,text:string,bbox:array<double>>>,relationships:array<struct<id:string>>,assets:array<struct<id:string,part:string>>,"
    "requested_targets:array<string>,vision:array<struct<target:string,image_role:string,slide_reading_order:string,flow_present:boolean,diagram_flow_direction:string>>>"
)
#: Statuses that evidence may have.
STATUSES = ("verified", "partial", "unverified", "failed", "not_requested", "not_applicable")
COLLECTIONS = ("slides", "objects", "assets", "relationships", "rendered_evidence", "ocr_evidence", "vision_evidence")


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, deck_id, record, raw) of the valid records, and (path, reasons) of the others; deck_id is the hash of the file's text."""
    d = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    d = d.select("path", F.sha2("raw", 256).alias("deck_id"), F.from_json("raw", RECORD).alias("record"), "raw")
    r = F.col("record")
    ids = lambda c: F.coalesce(F.transform(r[c], lambda x: x["id"]), F.array().cast("array<string>"))
    twice = lambda c: F.size(F.array_distinct(ids(c))) < F.size(ids(c))
    evidence = F.flatten(F.array(*[F.coalesce(r[c], F.array().cast(EVIDENCE)) for c in COLLECTIONS if c.endswith("evidence")]))
    reasons = F.array_compact(F.array(
        F.when(r.isNull() | r["deck"].isNull(), "not_a_record"), F.when(r["schema_version"].isNull(), "no_version"), *[F.when(r[c].isNull(), f"no_{c}") for c in COLLECTIONS],
        *[F.when(twice(c), f"repeated_{c}_id") for c in ("slides", "objects", "assets")],
        F.when(F.exists(r["objects"], lambda o: ~F.array_contains(ids("slides"), o["slide_id"])), "object_without_slide"),
        F.when(F.exists(evidence, lambda e: ~F.coalesce(e["status"].isin(*STATUSES), F.lit(False))), "evidence_status"),
        F.when(F.exists(evidence, lambda e: F.coalesce(F.isnan(e["confidence"]) | ~e["confidence"].between(0.0, 1.0), F.lit(False))), "evidence_confidence"),
    ))
    d = d.withColumn("reasons", F.when(r.isNull() | (r["deck"].isNull() & r["schema_version"].isNull()), F.array(F.lit("not_a_record"))).otherwise(reasons))
    return d.where(F.size("reasons") == 0).drop("reasons"), d.where(F.size("reasons") > 0).select("path", "reasons")


def _box(c):
    return [F.get(c, F.lit(i)).alias(k) for i, k in enumerate("xywh")]


def slides_of(records: DataFrame) -> DataFrame:
    """(deck_id, slide_id, slide_number, text, notes, hyperlinks)."""
    d = records.select("deck_id", F.explode("record.slides").alias("s"))
    return d.select("deck_id", F.col("s.id").alias("slide_id"), F.col("s.number").alias("slide_number"), "s.text", "s.notes", "s.hyperlinks")


def objects_of(records: DataFrame) -> DataFrame:
    """(deck_id, slide_number, object_id, parent_id, type, name, text, x, y, w, h, z_order, asset_id, native_id)."""
    d = records.select("deck_id", "record.slides", F.explode("record.objects").alias("o"))
    number = F.get(F.transform(F.filter("slides", lambda s: s["id"] == F.col("o.slide_id")), lambda s: s["number"]), F.lit(0))
    return d.select("deck_id", number.alias("slide_number"), F.col("o.id").alias("object_id"), "o.parent_id", "o.type", "o.name", "o.text", *_box(F.col("o.bbox")), "o.z_order", "o.asset_id", "o.native_id")


def assets_of(records: DataFrame) -> DataFrame:
    """(deck_id, asset_id, part, content_type, sha256, size)."""
    return records.select("deck_id", F.explode("record.assets").alias("a")).select("deck_id", F.col("a.id").alias("asset_id"), "a.part", "a.content_type", "a.sha256", "a.size")


def evidence_of(records: DataFrame) -> DataFrame:
    """(deck_id, layer, evidence_id, slide_id, object_id, status, confidence, x, y, w, h, value): the records of all layers in one table; value is JSON."""
    out = None
    for c in COLLECTIONS:
        if c.endswith("evidence"):
            d = records.select("deck_id", F.lit(c.removesuffix("_evidence")).alias("layer"), F.explode(f"record.{c}").alias("e"))
            d = d.select("deck_id", "layer", F.col("e.id").alias("evidence_id"), "e.slide_id", "e.object_id", "e.status", "e.confidence", *_box(F.col("e.bbox")), "e.value")
            out = d if out is None else out.unionByName(d)
    return out


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """(deck_id, layer, status, n): how much of each layer came out how."""
    return evidence.groupBy("deck_id", "layer", "status").agg(F.count("*").alias("n"))


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, labels): labels of decks; a file that isn't JSON gives null labels."""
    d = spark.read.text(paths, wholetext=True)
    return d.select(F.input_file_name().alias("path"), F.from_json("value", LABELS).alias("labels"))


def environment(path: str, keep: bool = True) -> dict[str, str]:
    """Settings from a file of KEY=value lines; blank lines and those from # on are skipped, quotes around a value removed. With ``keep``, a variable of the process wins."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, sep, value = line.strip().removeprefix("export ").partition("=")
            if sep and key.strip() and not key.startswith("#"):
                value = value.strip()
                out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return {k: os.environ.get(k, v) if keep else v for k, v in out.items()}
