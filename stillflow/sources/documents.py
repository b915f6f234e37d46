"""Scan, selection and manifest documents: JSON with fixed schemas and strict versions, written whole or not at all."""

from __future__ import annotations

import configparser
import json
import os
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Versions, fields and their order in the documents.
SCAN_VERSION, SELECT_VERSION, MANIFEST_VERSION = 4, 3, 1

VIDEO = "struct<path string, filename string, width int, height int, fps double, frame_count int, declared_frame_count int, duration_s double>"
BOX = "struct<x int, y int, w int, h int>"
SCENE = "struct<id int, start int, `end` int, start_i int, end_i int, start_t double, end_t double, frame_count int, best_frame int, best_sharpness double, mean_sharpness double>"
FRAME = "struct<i int, t double, sharpness double, luma double, highlight_frac double, delta double, dhash string, scene int>"
PICK = "struct<frame int, t double, scene int, sharpness double, dhash string, window array<int>>"
STILL = "struct<file string, frame int, scene int, t double, seed int, window array<int>, source_frames array<int>, source_sharpness double, width int, height int, restored boolean>"
SCAN = f"scan_version int, video {VIDEO}, content_box {BOX}, scan map<string, string>, scenes array<{SCENE}>, frames array<{FRAME}>"
SELECTION = f"select_version int, scan_version int, video {VIDEO}, content_box {BOX}, `select` map<string, string>, scenes array<{SCENE}>, picks array<{PICK}>"
MANIFEST = f"manifest_version int, created_utc string, still_count int, stills array<{STILL}>, contact_sheet string, restore_params map<string, string>, video {VIDEO}, content_box {BOX}, `select` map<string, string>, scenes array<{SCENE}>"


def _read(spark: SparkSession, path: str, schema: str, key: str, version: int) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    fits = F.assert_true(F.col(key).eqNullSafe(version), F.lit(f"{key} must be {version}"))
    return rows.filter(fits.isNull())


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """Scan documents; another version is an error."""
    return _read(spark, path, SCAN, "scan_version", SCAN_VERSION)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SELECTION, "select_version", SELECT_VERSION)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def scan_frames(scans: DataFrame) -> DataFrame:
    return scans.select("video.filename", F.inline("frames"))


def prior_restored(manifests: DataFrame) -> DataFrame:
    """file, restored of manifests; a still without the field counts as restored."""
    return manifests.select(F.explode("stills").alias("s")).select("s.file", F.coalesce("s.restored", F.lit(True)).alias("restored"))


def write_document(document: dict, path: str) -> None:
    """A JSON file that appears whole: written beside its place under a name that no listing takes, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(suffix=".part", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(document, file, indent=2)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def build_manifest(stills: list[dict], contact_sheet: str | None = None, restore_params: dict | None = None, **more) -> dict:
    """A manifest of still entries, in the fields of the schema; restore_params only where a still is restored, null fields left out."""
    fields = [f.name for f in T.StructType.fromDDL(f"s {STILL}")["s"].dataType]
    entries = [{name: s[name] for name in fields if s.get(name) is not None} for s in stills]
    anything_restored = any(s.get("restored", True) for s in stills)
    facts = {"contact_sheet": contact_sheet, "restore_params": restore_params if anything_restored else None, **more}
    made = {"manifest_version": MANIFEST_VERSION, "created_utc": datetime.now(UTC).isoformat(timespec="seconds"), "still_count": len(entries), "stills": entries}
    return made | {name: fact for name, fact in facts.items() if fact}


def read_settings(path: str = ".env") -> dict[str, str]:
    """Settings of a file of names and values, and over them those of the environment. Without the file, the environment alone."""
    parser = configparser.RawConfigParser(delimiters=("=",), comment_prefixes=("#",), allow_no_value=True, strict=False, empty_lines_in_values=False)
    parser.optionxform = str
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            parser.read_string("[settings]\n" + "".join(line.lstrip() for line in file))
    said = parser["settings"] if parser.has_section("settings") else {}
    return {k: v.strip("\"'") for k, v in said.items() if v} | dict(os.environ)
