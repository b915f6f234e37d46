"""Still files as rows: provenance from their names, what is left to do, variants, and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillflow.functions.names import is_upscaled, parse_still_name, still_name, upscaled_name

NO_FRAME, NO_SEED = 1 << 30, -1


def collect_stills(files: DataFrame, picks: DataFrame) -> DataFrame:
    """files (file) with scene, frame, seed of their names, and t, sharpness, window, source_frames of the pick of that frame.

    Files that match no pick stay. The order for sheets is by frame, seed and name: sort_key.
    """
    named = files.select("*", parse_still_name(F.col("file")).alias("_n")).select(*files.columns, "_n.scene", "_n.frame", "_n.seed")
    pick = picks.select("frame", "t", F.col("sharpness").alias("source_sharpness"), "window")
    joined = named.join(pick, "frame", "left")
    frames = F.when(F.col("window").isNotNull(), F.sequence(F.col("window")[0], F.col("window")[1]))
    key = F.struct(F.coalesce("frame", F.lit(NO_FRAME)).alias("frame"), F.coalesce("seed", F.lit(NO_SEED)).alias("seed"), "file")
    return joined.withColumns({"source_frames": frames, "sort_key": key})


def with_restored(stills: DataFrame, prior: DataFrame) -> DataFrame:
    """restored as a manifest (file, restored) has it; files that none accounts for count as restored."""
    return stills.join(prior.select("file", F.coalesce("restored", F.lit(True)).alias("_was")), "file", "left").withColumn("restored", F.coalesce("_was", F.lit(True))).drop("_was")


def seed_variants(picks: DataFrame, seed: int, seeds: int) -> DataFrame:
    """picks for each of seeds seeds from seed on; a single one leaves no trace in names."""
    each = picks.withColumn("seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + seeds - 1))))
    return each.withColumn("name_seed", F.when(F.lit(seeds > 1), F.col("seed")))


def resume_todo(wanted: DataFrame, present: DataFrame, restoring: bool = True, force: bool = False) -> DataFrame:
    """wanted (file, ...) and state: todo, done or stale (present as an unrestored capture while restoring). present: file, restored."""
    have = present.select("file", F.coalesce("restored", F.lit(True)).alias("_r"), F.lit(True).alias("_have"))
    state = F.when(F.col("_have").isNull() | F.lit(force), "todo").when(F.lit(restoring) & ~F.col("_r"), "stale").otherwise("done")
    return wanted.join(have, "file", "left").withColumn("state", state).drop("_r", "_have")


def kept_stills(files: DataFrame, picks: DataFrame, prior: DataFrame, force: bool = False) -> DataFrame:
    """files (file) that survived a review and state: upscaled (a result itself), done, orphan (no pick), present (its result exists), todo."""
    named = files.withColumn("frame", parse_still_name(F.col("file"))["frame"]).withColumn("out", upscaled_name(F.col("file")))
    known = named.join(picks.select("frame", F.lit(True).alias("_pick")), "frame", "left")
    known = known.join(prior.filter("restored").select("file", F.lit(True).alias("_done")), "file", "left")
    known = known.join(files.select(F.col("file").alias("out"), F.lit(True).alias("_out")), "out", "left")
    state = F.when(is_upscaled(F.col("file")), "upscaled").when(F.col("_done"), "done").when(F.col("_pick").isNull(), "orphan").when(F.col("_out") & F.lit(not force), "present").otherwise("todo")
    return known.select("file", "frame", state.alias("state"))


def variant_labels(stills: DataFrame, *keys: str) -> DataFrame:
    """variant: upscaled or source, only where a set holds both."""
    both = Window.partitionBy(*keys)
    mixed = (F.count_if(~F.col("restored")).over(both) > 0) & (F.count_if("restored").over(both) > 0)
    return stills.withColumn("variant", F.when(mixed, F.when(F.col("restored"), "upscaled").otherwise("source")))


def group_variants(stills: DataFrame, *keys: str) -> DataFrame:
    """Files of each frame, in name order."""
    return stills.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list("file")).alias("files"), F.count("*").cast("int").alias("n"))


MANIFEST_FIELDS = ("file", "frame", "scene", "t", "seed", "window", "source_frames", "source_sharpness", "width", "height", "restored")


def manifest_rows(stills: DataFrame) -> DataFrame:
    """file and its manifest entry as JSON: only known fields, null ones left out."""
    return stills.select("file", F.to_json(F.struct(*(c for c in MANIFEST_FIELDS if c in stills.columns)), {"ignoreNullFields": "true"}).alias("entry"))


def manifest_counts(stills: DataFrame, *keys: str) -> DataFrame:
    """How many stills (restored, and t of their pick), how many of them captures, how many with a known pick."""
    return stills.groupBy(*keys).agg(F.count("*").alias("stills"), F.count_if(~F.col("restored")).alias("raw"), F.count_if(F.col("t").isNotNull()).alias("with_provenance"))


def provenance_gaps(stills: DataFrame) -> DataFrame:
    """unnamed: files whose names tell no frame; unmatched: whose frame no pick has; with three of each, in name order."""
    gaps = {"unnamed": F.col("frame").isNull(), "unmatched": F.col("frame").isNotNull() & F.col("t").isNull()}
    some = [F.slice(F.array_sort(F.collect_list(F.when(c, F.col("file")))), 1, 3).alias(f"{n}_files") for n, c in gaps.items()]
    return stills.agg(*(F.count_if(c).alias(n) for n, c in gaps.items()), *some)


def still_names(picks: DataFrame, stem: str) -> DataFrame:
    seed = F.col("name_seed") if "name_seed" in picks.columns else None
    return picks.withColumn("file", still_name(F.col(stem), F.col("scene"), F.col("frame"), seed))
