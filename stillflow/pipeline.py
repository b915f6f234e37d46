"""Scan, select, restore and publish one video or picture folder: documents in, documents out, finished work kept.

Finished stages are reused if their document has the right version and was made with the same options (their hash is
kept in it), so a changed option is never ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillflow.functions.hashing import hex_to_long
from stillflow.functions.names import VIDEO_EXTENSIONS, upscaled_name
from stillflow.functions.pixels import content_box
from stillflow.operators import preview, restore, scenes, selection, sheet, stills
from stillflow.sources import documents, images, video


def option_key(**options) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]


def load_frames(spark: SparkSession, path: str, fps: float = 25.0, workers: int | None = None) -> DataFrame:
    """Frames of a folder of PNG files (at fps frames a second), or of a video file (at its own rate, in about workers ranges)."""
    if os.path.splitext(path)[1].lower() in VIDEO_EXTENSIONS:
        video.register(spark)
        reader = spark.read.format("frames_of_video").option("path", path)
        return (reader.option("partitions", workers) if workers else reader).load()
    return images.png_frames(spark, path, fps)


def _row(r) -> dict:
    return {k: v for k, v in r.asDict(recursive=True).items() if k != "video_id"}


def scan(
    spark: SparkSession, path: str, fps: float = 25.0, threshold: float = scenes.SCENE_THRESHOLD, min_len: int = scenes.MIN_SCENE_LEN, box: bool = True, segments: list[tuple[float, float]] | None = None, workers: int | None = None
) -> dict:
    """A scan document: metric rows, scenes, the content box. fps is for picture folders; a video's times are its own."""
    key = option_key(fps=fps, threshold=threshold, min_len=min_len, box=box, segments=segments)
    frames = load_frames(spark, path, fps, workers)
    size = frames.select("width", "height", "fps").first()
    if size is None:
        raise OSError(f"no frames in {path}")
    fps = size.fps
    found = images.content_boxes(frames).first() if box else None
    area = (found.x, found.y, found.w, found.h) if found else (0, 0, size.width, size.height)
    metrics = images.measure(frames, area)
    if segments:
        wanted = spark.createDataFrame([(path, float(a), float(b)) for a, b in segments], "video_id string, from_t double, to_t double")
        placed = scenes.in_segments(metrics, scenes.merge_segments(wanted, fps))
        bounds = scenes.segment_scenes(placed, threshold, min_len).drop("seg")
    else:
        placed = scenes.with_position(metrics)
        bounds = scenes.scene_bounds(placed, threshold, min_len)
    placed = scenes.assign_scenes(placed, bounds).persist()
    rows = [_row(r) for r in placed.orderBy("pos").select("i", "t", "sharpness", "luma", "highlight_frac", "delta", "dhash", "scene", "video_id").collect()]
    cut = [_row(r) for r in scenes.scene_stats(placed).orderBy("id").collect()]
    placed.unpersist()
    return {
        "scan_version": documents.SCAN_VERSION, "video": {"path": path, "filename": os.path.basename(path), "width": size.width, "height": size.height, "fps": round(fps, 6), "frame_count": len(rows), "duration_s": round(len(rows) / fps, 3)},
        "content_box": dict(zip("xywh", area, strict=True)), "scan": {"scene_threshold": threshold, "min_scene_len": min_len, "options": key}, "scenes": cut, "frames": rows,
    }


def select(spark: SparkSession, scanned: dict, interval: float = 0.0, by_frame_number: bool = False, **options) -> dict:
    """A selection document of a scan document: one still an interval, or by scenes if interval is 0."""
    fps, name = scanned["video"]["fps"], scanned["video"]["filename"]
    frame_rows = [(name, p, f["i"], f["t"], f["sharpness"], f["luma"], f["highlight_frac"], f["dhash"], f["scene"]) for p, f in enumerate(scanned["frames"])]
    frames = spark.createDataFrame(frame_rows, "name string, pos int, i int, t double, sharpness double, luma double, highlight_frac double, hex string, scene int").withColumns({"video_id": F.lit(0).cast("long"), "dhash": hex_to_long(F.col("hex"))})
    o = selection.Options(fps=fps, **options)
    if interval:
        picked = selection.select_interval(frames, interval, o.window)
        facts = picked.agg(F.count("*").alias("intervals"), F.count_if("unsafe").alias("window_unsafe")).first().asDict()
        more = {"mode": "interval", "window": o.window, "interval_s": interval, "eligible_frames": len(frame_rows), **facts}
    else:
        judged = selection.judge_frames(frames, o)
        picked = selection.select_scene(judged, o, by_frame_number)
        stats, weak = selection.select_stats(judged, o).first(), selection.weak_counts(judged).first()
        gaps = selection.scene_gap(judged, o).orderBy("scene").collect()
        more = {
            "mode": "scene", "window": o.window, "seconds_per_still": o.seconds_per_still, "per_scene_max": o.per_scene_max, "hash_distance": o.hash_distance, "min_gap_s": o.min_gap_s, "min_gap_frames": o.min_gap, "gap_fraction": o.gap_fraction,
            "scene_gap_frames": {str(r.scene): r.gap for r in gaps}, "scene_quota": {str(r.scene): r.quota for r in gaps}, "min_sharpness_frac": o.min_sharpness_frac, "min_luma": o.min_luma, "max_highlight_frac": o.max_highlight_frac,
            "rejected_weak": {k: weak[k] for k in ("too_dark", "too_soft", "blown_highlights")}, "scenes_unusable": stats.scenes_unusable, "eligible_frames": stats.eligible_frames,
        }
    hexes = {f["i"]: f["dhash"] for f in scanned["frames"]}
    rows = picked.orderBy("frame").collect()
    if not interval:
        more["filled"] = sum(r.filled for r in rows)
    pair = selection.closest_pairs(picked).first()
    if pair:
        more["closest_pair"] = {"distance": pair.d, "frames": [pair.fa, pair.fb]}
    picks = [{"frame": r.frame, "t": r.t, "scene": r.scene, "sharpness": r.sharpness, "dhash": hexes[r.frame], "window": list(r.window)} for r in rows]
    key = option_key(scan=scanned["scan"]["options"], interval=interval, by_frame_number=by_frame_number, **options)
    return {k: scanned[k] for k in ("scan_version", "video", "content_box", "scenes")} | {"select_version": documents.SELECT_VERSION, "select": {**more, "selected": len(picks), "options": key}, "picks": picks}


def _write_windows(spark: SparkSession, path: str, wanted: DataFrame, chosen: dict, out: str, model: restore.Restorer, fps: float, parameters: dict | None = None) -> list[str]:
    """Restores the window around each wanted (video_id, frame, file, seed) with parameters and writes it to its file in out.

    Windows are gathered, cut to the content box and restored in the cluster; pictures go to files one at a time on the
    driver, each under a name that no listing takes until it is whole.
    """
    box = tuple(chosen["content_box"][k] for k in "xywh")

    def run(pdf):
        def one(r) -> bytes:
            x, y, w, h = box
            stack = [np.frombuffer(m["data"], np.uint8).reshape(m["height"], m["width"], 3)[y : y + h, x : x + w, ::-1] for m in r["members"]]
            more = {"seed": int(r["seed"])} if model.takes_seed else {}
            return images.png_bytes(model.restore(np.stack(stack), **(parameters or {}), **more))

        def tried(r) -> tuple[str, bytes | None, str | None]:
            """An error stays with its still."""
            try:
                return r["file"], one(r), None
            except Exception as error:  # noqa: BLE001
                return r["file"], None, f"{type(error).__name__}: {error}"

        for rows in pdf:
            yield pd.DataFrame([tried(r) for _, r in rows.iterrows()], columns=["file", "png", "error"])

    if wanted.isEmpty():
        return []
    windows = restore.restore_windows(wanted.select("video_id", "frame").distinct(), load_frames(spark, path, fps), ["data", "height", "width"], chosen["select"]["window"])
    missing = windows.filter(~F.col("complete")).select("frame").limit(3).collect()
    if missing:
        raise OSError(f"frames are missing around {[r.frame for r in missing]}")
    made = windows.join(wanted.select("frame", "file", "seed"), "frame").select("file", "seed", "members").mapInPandas(run, "file string, png binary, error string")
    done, failed = [], []
    for r in made.toLocalIterator():
        if r.error:
            failed.append(f"{r.file}: {r.error}")
            continue
        images.write_whole(r.png, os.path.join(out, r.file))
        done.append(r.file)
    if failed:
        raise RuntimeError(f"{len(failed)} of {len(failed) + len(done)} stills failed, the others are written; {'; '.join(sorted(failed)[:3])}")
    return sorted(done)


def _picks(spark: SparkSession, path: str, chosen: dict) -> DataFrame:
    stem = os.path.splitext(chosen["video"]["filename"])[0]
    return spark.createDataFrame([(path, p["frame"], p["scene"], stem) for p in chosen["picks"]], "video_id string, frame int, scene int, stem string")


def _present(spark: SparkSession, folder: str, manifest: str | None) -> DataFrame:
    """file, restored of the stills in a folder, as its manifest has them; unknown ones have null."""
    names = spark.createDataFrame([(f,) for f in sorted(os.listdir(folder)) if f.endswith(".png")], "file string")
    if not manifest or not os.path.exists(manifest):
        return names.withColumn("restored", F.lit(None).cast("boolean"))
    return names.join(documents.prior_restored(documents.read_manifest(spark, manifest)), "file", "left")


def restore_picks(
    spark: SparkSession, path: str, chosen: dict, out: str, restorer: restore.Restorer | None = None, fps: float = 25.0, force: bool = False, seed: int = restore.SEED, seeds: int = 1, manifest: str | None = None, parameters: dict | None = None
) -> list[str]:
    """Writes the stills of a selection that a folder lacks (one for each of seeds seeds); returns their names.

    Without a restorer the middle frames are captured, where seeds and parameters mean nothing. Stills that an earlier run
    captured are not restored over: the run stops unless forced.
    """
    if restorer is not None and seeds > 1 and not restorer.takes_seed:
        raise ValueError(f"{type(restorer).__name__} makes the same still of every seed: ask for one")
    os.makedirs(out, exist_ok=True)
    picks = stills.seed_variants(_picks(spark, path, chosen), seed, seeds if restorer else 1)
    state = stills.resume_todo(stills.still_names(picks, "stem"), _present(spark, out, manifest), restoring=restorer is not None, force=force)
    stale = state.filter("state = 'stale'").select("file").limit(1).collect()
    if stale:
        raise RuntimeError(f"{out} holds captures, as {stale[0].file}: delete what is not wanted and use upscale_stills, or force the whole run")
    wanted = state.filter("state = 'todo'").select("video_id", "frame", "file", "seed")
    return _write_windows(spark, path, wanted, chosen, out, restorer or restore.Centre(), fps, parameters if restorer else None)


def upscale_stills(spark: SparkSession, path: str, chosen: dict, out: str, restorer: restore.Restorer, fps: float = 25.0, force: bool = False, manifest: str | None = None, seed: int = restore.SEED, parameters: dict | None = None) -> dict[str, list[str]]:
    """Restores, beside them, the captures that survived a review of the folder; returns the files by state."""
    present = _present(spark, out, manifest)
    picks = _picks(spark, path, chosen)
    kept = stills.kept_stills(present.select("file"), picks, present.withColumn("restored", F.coalesce("restored", F.lit(False))), force).persist()
    states: dict[str, list[str]] = {}
    for r in kept.orderBy("file").collect():
        states.setdefault(r.state, []).append(r.file)
    todo = kept.filter("state = 'todo'").join(picks.select("video_id", "frame"), "frame")
    states["written"] = _write_windows(spark, path, todo.select("video_id", "frame", upscaled_name(F.col("file")).alias("file"), F.lit(seed).alias("seed")), chosen, out, restorer, fps, parameters)
    kept.unpersist()
    return states


def restore_folder(spark: SparkSession, folder: str, restorer: restore.Restorer, window: int = 0, crop_pillarbox: bool = False, seed: int = restore.SEED, seeds: int = 1, parameters: dict | None = None, out: str | None = None) -> list[str]:
    """One still (for each of seeds seeds) of a folder of PNG files that is a window; window: only so many in the middle.

    crop_pillarbox: pictures are cut to what any of them lights. Returns the files written.
    """
    if seeds > 1 and not restorer.takes_seed:
        raise ValueError(f"{type(restorer).__name__} makes the same still of every seed: ask for one")
    frames = images.png_frames(spark, folder)
    n = frames.select("i").count()
    if window and window < n:
        first = (n - window) // 2
        frames = frames.filter(F.col("i").between(first, first + window - 1))
    rows = frames.orderBy("i").collect()  # one window
    if not rows:
        raise OSError(f"no PNG files in {folder}")
    stack = np.stack([np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in rows])
    if crop_pillarbox:
        x, y, w, h = content_box(stack.max((0, 3)))
        stack = stack[:, y : y + h, x : x + w]
    base, end = os.path.splitext(out or os.path.join(os.path.dirname(os.path.abspath(folder)), f"{os.path.basename(os.path.abspath(folder))}_restored_centre.png"))
    done = []
    for s in range(seed, seed + seeds):
        more = {"seed": s} if restorer.takes_seed else {}
        name = f"{base}_seed{s}{end}" if seeds > 1 else base + end
        images.write_png(restorer.restore(stack[..., ::-1], **(parameters or {}), **more), name)
        done.append(name)
    return done


def publish(
    spark: SparkSession, folder: str, chosen: dict | None, out_sheet: str, out_manifest: str, restored: bool = True, written: list[str] | None = None, restore_params: dict | None = None, title: str | None = None, quality: int = sheet.QUALITY, **layout
) -> dict:
    """The contact sheet and the manifest of a folder of stills. restored holds for files just written (all, if unsaid);
    what an earlier manifest says of the others holds, and files that none accounts for count as restored. restore_params:
    how the files just written were restored; without any, what the earlier manifest says of it holds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")
    sizes = spark.read.format("image").option("pathGlobFilter", "*.png").load(folder).select(F.regexp_extract("image.origin", "[^/]*$", 0).alias("file"), "image.width", "image.height")
    picks = spark.createDataFrame([(p["frame"], p["t"], p["sharpness"], p["window"]) for p in (chosen or {}).get("picks", [])], "frame int, t double, sharpness double, window array<int>")
    new = spark.createDataFrame([(f, restored) for f in (os.listdir(folder) if written is None else written)], "file string, restored boolean")
    known = new
    if os.path.exists(out_manifest):
        with open(out_manifest, encoding="utf-8") as file:
            restore_params = restore_params or json.load(file).get("restore_params")
        known = new.unionByName(documents.prior_restored(documents.read_manifest(spark, out_manifest)).join(new, "file", "left_anti"))
    rows = stills.variant_labels(stills.with_restored(stills.collect_stills(files, picks).join(sizes, "file"), known)).withColumn("sheet", F.lit(0))
    first, second = sheet.labels()
    cells = [r.asDict(recursive=True) for r in sheet.sheet_layout(rows, ["sort_key"], **layout).withColumns({"first": first, "second": second}).orderBy("ordinal").collect()]
    name = chosen["video"]["filename"] if chosen else os.path.basename(folder)
    sheet.render_sheet(spark, cells, (cells[0]["sheet_w"], cells[0]["sheet_h"]) if cells else (1, 1), out_sheet, f"{name}   {len(cells)} stills" if title is None else title, quality)
    more = {k: chosen[k] for k in ("video", "content_box", "select", "scenes")} if chosen else {}
    made = documents.build_manifest(cells, os.path.basename(out_sheet), restore_params, **more)
    documents.write_document(made, out_manifest)
    return made


def _fresh(path: str, version: str, number: int, part: str, key: str) -> dict | None:
    """The document at path, if it has the version and the options."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            document = json.load(file)
        if document.get(version) == number and document.get(part, {}).get("options") == key:
            return document
    return None


def run(
    spark: SparkSession, path: str, out: str, fps: float = 25.0, force: bool = False, restorer: restore.Restorer | None = None, interval: float = 0.0, scan_options: dict | None = None, seeds: int = 1, upscale: bool = False, seed: int = restore.SEED, parameters: dict | None = None, layout: dict | None = None, **options
) -> dict:
    """All stages of one input into out/: work/scan.json, work/select.json, stills/, contact_sheet.jpg, manifest.json.

    upscale: what is left of an earlier run's captures is restored, instead of the selection. parameters: of the restorer.
    """
    work, folder = os.path.join(out, "work"), os.path.join(out, "stills")
    os.makedirs(work, exist_ok=True)
    so = {"threshold": scenes.SCENE_THRESHOLD, "min_len": scenes.MIN_SCENE_LEN, "box": True, "segments": None} | (scan_options or {})
    scan_key = option_key(fps=fps, **{k: v for k, v in so.items() if k != "workers"})
    scanned = None if force else _fresh(f"{work}/scan.json", "scan_version", documents.SCAN_VERSION, "scan", scan_key)
    if scanned is None:
        scanned = scan(spark, path, fps, **so)
        documents.write_document(scanned, f"{work}/scan.json")
    key = option_key(scan=scan_key, interval=interval, by_frame_number=False, **options)
    chosen = None if force else _fresh(f"{work}/select.json", "select_version", documents.SELECT_VERSION, "select", key)
    if chosen is None:
        chosen = select(spark, scanned, interval, **options)
        documents.write_document(chosen, f"{work}/select.json")
    record, params = f"{out}/manifest.json", None
    model = restorer or (restore.Mean() if upscale else None)
    if upscale:
        os.makedirs(folder, exist_ok=True)
        made = upscale_stills(spark, path, chosen, folder, model, fps, force, record, seed, parameters)["written"]
    else:
        made = restore_picks(spark, path, chosen, folder, model, fps, force, seed, seeds, record, parameters)
    if model is not None and made:
        params = {"method": type(model).__name__.lower(), **model.defaults, **(parameters or {})} | ({"seed": seed, "seeds": seeds} if model.takes_seed else {})
    manifest = publish(spark, folder, chosen, f"{out}/contact_sheet.jpg", record, written=made, restored=model is not None, restore_params=params, **(layout or {}))
    return {"written": made, "stills": manifest["still_count"]}


def run_quick_preview(spark: SparkSession, path: str, out: str, count: int = preview.COUNT, fps: float = 25.0, layout: dict | None = None) -> list[int]:
    """The sharpest frame of each of count windows as PNG files and a sheet in out/preview; nothing else reads these."""
    frames = load_frames(spark, path, fps)
    videos = frames.groupBy("video_id").agg(F.count("*").cast("int").alias("frame_count"), F.first("fps").alias("fps")).collect()
    windows = preview.preview_windows(spark.createDataFrame(videos, "video_id string, frame_count int, fps double"), count)
    wanted = windows.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("i")).distinct()
    metrics = images.measure(frames.join(wanted, "i"))
    best = preview.quick_preview(metrics, windows).orderBy("frame").select("frame").collect()
    folder = os.path.join(out, "preview")
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        if name.endswith(".png"):
            os.unlink(os.path.join(folder, name))
    stem = os.path.splitext(os.path.basename(path))[0][:32]
    for r in frames.join(spark.createDataFrame(best, "frame int").withColumnRenamed("frame", "i"), "i").toLocalIterator():
        images.write_png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[..., ::-1], os.path.join(folder, f"{stem}_f{r.i:06d}.png"))
    publish(spark, folder, None, os.path.join(folder, "contact_sheet.jpg"), os.path.join(folder, "manifest.json"), restored=False, **(layout or {}))
    return [r.frame for r in best]


def run_folder(spark: SparkSession, paths: list[str], out: str, **options) -> dict[str, str]:
    """run() for each input; an error stays with its input."""
    status = {}
    for path in paths:
        try:
            run(spark, path, os.path.join(out, os.path.splitext(os.path.basename(path))[0]), **options)
            status[path] = "done"
        except Exception as error:  # noqa: BLE001
            status[path] = f"failed: {error}"
    return status
