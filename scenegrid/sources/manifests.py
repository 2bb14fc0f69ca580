"""Scene manifests as JSON lines: an explicit schema, and a code for every record that isn't one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.operators.rules import json_code

SCENE = (
    "struct<schema_version: int, id: string, revision: int, canvas: struct<width: double, height: double>, objects: array<struct<"
    "id: string, kind: string, z_index: double, group: string, box: struct<x: double, y: double, width: double, height: double>, text: string>>>"
)
KEYS = ("schema_version", "id", "revision", "canvas", "objects", "source", "recognition")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: the record (null where it isn't one), its digest, and a code: ``malformed``, ``version``,
    ``revision``, ``unknown_key`` or ``ok``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    good = json_code(F.col("value")) == "ok"
    scene = F.when(good, F.from_json("value", SCENE))
    unknown = F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, KEYS)))) > 0
    code = F.when(~good | F.col("scene.id").isNull(), "malformed").when(~F.col("scene.schema_version").eqNullSafe(1), "version").when(~F.coalesce(F.col("scene.revision") >= 1, F.lit(False)), "revision").when(unknown, "unknown_key").otherwise("ok")
    return lines.select("value", scene.alias("scene")).select("scene", F.sha2("value", 256).alias("digest"), code.alias("code"))


def objects(manifests: DataFrame) -> DataFrame:
    """The objects of the records that are in order: scene_id, ordinal, and the fields."""
    rows = manifests.where("code = 'ok'").select(F.col("scene.id").alias("scene_id"), F.posexplode("scene.objects").alias("ordinal", "o"))
    return rows.select("scene_id", F.col("ordinal").cast("long").alias("ordinal"), "o.*")
