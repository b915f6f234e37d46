"""The engine on a made-up video of 300 frames, and small cases with known answers."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillflow.functions import names, pixels, timecode
from stillflow.functions.hashing import hamming, hex_to_long
from stillflow.operators import preview, restore, scenes, selection, sheet, stills
from stillflow.sources import documents, images, video
from stillflow.streaming import frames as streams


def made_up(offset=0):
    k = np.arange(300)
    hashes = (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return pd.DataFrame(
        {
            "video_id": 1, "i": k + offset, "t": np.round((k + offset) / 25, 4), "sharpness": 100.0 + 37 * k % 101, "luma": np.where((k >= 40) & (k < 45), 10.0, 100.0),
            "highlight_frac": np.where((k >= 140) & (k < 143), 0.5, 0.0), "delta": np.where(np.isin(k, [100, 108, 200, 295]), 50.0, 5.0), "dhash": hashes,
        }
    )


@pytest.fixture(scope="module")
def scanned(spark):
    frames = scenes.with_position(spark.createDataFrame(made_up()))
    placed = scenes.assign_scenes(frames, scenes.scene_bounds(frames))
    return placed.cache(), scenes.scene_stats(placed).cache()


def picks(scanned, by_number=False, **more):
    o = selection.Options(fps=25.0, **more)
    rows = selection.select_scene(selection.judge_frames(scanned[0], o), o, by_number).orderBy("frame").collect()
    return [r.frame for r in rows], sum(r.filled for r in rows)


def test_scenes(scanned):
    rows = scanned[1].orderBy("id").collect()
    assert [(r.start, r.end, r.best_frame, r.best_sharpness) for r in rows] == [(0, 99, 30, 200), (100, 199, 131, 200), (200, 299, 232, 200)]
    assert [round(r.mean_sharpness, 2) for r in rows] == [149.86, 150.23, 149.59]


@pytest.mark.parametrize("frac, soft, left", [(0.35, 0, 280), (0.75, 138, 142)])
def test_weak_frames(scanned, frac, soft, left):
    judged = selection.judge_frames(scanned[0], selection.Options(fps=25.0, min_sharpness_frac=frac))
    r = selection.weak_counts(judged).first()
    assert (r.too_dark, r.blown_highlights, r.too_soft, r.eligible_frames) == (5, 3, soft, left)


TWELVE = [19, 30, 60, 90, 120, 131, 161, 191, 221, 232, 262, 292]


@pytest.mark.parametrize(
    "more, frames, filled",
    [
        ({}, [30, 131, 232], 0), ({"seconds_per_still": 1.0}, TWELVE, 0), ({"seconds_per_still": 1.0, "hash_distance": 30}, [19, 30, 60, 87, 115, 125, 144, 190, 229, 279], 1),
        ({"seconds_per_still": 1.0, "min_gap_s": 2.0}, [19, 73, 125, 191, 248], 0), ({"seconds_per_still": 1.0, "window": 9}, TWELVE, 0),
    ],
)
def test_scene_picks(scanned, more, frames, filled):
    assert picks(scanned, **more) == (frames, filled)


@pytest.mark.parametrize(
    "offset, by_number, frames, filled",
    [
        (1000, False, [x + 1000 for x in TWELVE], 0), (1000, True, [1002, 1030, 1064, 1097, 1122, 1147, 1172, 1197, 1222, 1247, 1272, 1297], 12),
        (50, True, [69, 80, 125, 147, 170, 181, 204, 226, 271, 282, 314, 347], 6),
    ],
)
def test_segment_picks(spark, offset, by_number, frames, filled):
    rows = scenes.with_position(spark.createDataFrame(made_up(offset)))
    placed = scenes.assign_scenes(rows, scenes.scene_bounds(rows))
    assert picks((placed, scenes.scene_stats(placed)), by_number, seconds_per_still=1.0) == (frames, filled)


def test_picks_keep_their_distance(spark):
    rng = np.random.default_rng(1)
    rows = made_up().assign(sharpness=rng.integers(1, 9, 300) * 10.0, dhash=rng.integers(0, 2**62, 300), delta=np.where(rng.random(300) < 0.05, 40.0, 1.0), luma=rng.integers(0, 200, 300) * 1.0)
    frames = scenes.with_position(spark.createDataFrame(rows))
    placed = scenes.assign_scenes(frames, scenes.scene_bounds(frames))
    stats = scenes.scene_stats(placed)
    o = selection.Options(fps=25.0, seconds_per_still=0.5)
    judged = selection.judge_frames(placed, o)
    gaps = {r.scene: r.gap for r in selection.scene_gap(judged, o).collect()}
    bounds = {r.id: (r.start, r.end) for r in stats.collect()}
    out = selection.select_scene(judged, o).collect()
    assert {r.scene for r in out} == set(gaps)
    for a in out:
        assert bounds[a.scene][0] <= a.window[0] and a.window[1] <= bounds[a.scene][1]
        for b in out:
            if a.frame < b.frame:
                assert b.frame - a.frame >= (gaps[a.scene] if a.scene == b.scene else o.min_gap) or a.scene != b.scene
                assert b.frame - a.frame >= o.min_gap and bin((a.dhash ^ b.dhash) & (2**64 - 1)).count("1") >= o.hash_distance


@pytest.mark.parametrize("interval, frames, unsafe", [(2.0, [30, 60, 131, 161, 232, 262], 0), (0.1, [2, 4, 5, 8, 10, 13], 3)])
def test_interval_picks(scanned, interval, frames, unsafe):
    rows = selection.select_interval(scanned[0], interval).orderBy("bucket").collect()
    assert [r.frame for r in rows][:6] == frames and sum(r.unsafe for r in rows) == unsafe
    assert interval != 0.1 or len(rows) == 120


def test_greedy_cuts(spark):
    rows = [(1, i, 50.0 if i in (10, 20, 40, 95) else 0.0) for i in range(100)]
    bounds = scenes.scene_bounds(spark.createDataFrame(rows, "video_id int, pos int, delta double"), 27.0, 15).orderBy("id").collect()
    assert [(r.start, r.end) for r in bounds] == [(0, 19), (20, 39), (40, 99)]


def test_segments(spark):
    def merged(*parts):
        rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in parts], "video_id int, from_t double, to_t double")
        return [(r.start, r.stop) for r in scenes.merge_segments(rows, 25).orderBy("start").collect()]

    assert merged((0, 1), (1, 2)) == [(0, 51)]
    assert merged((10, 12), (0, 1)) == [(0, 26), (250, 301)]
    with pytest.raises(Exception, match="must end after"):
        merged((2, 2))


def test_preview_windows(spark):
    def windows(n, fps, count):
        v = spark.createDataFrame([(1, n, float(fps))], "video_id int, frame_count int, fps double")
        return [(r.start, r.stop) for r in preview.preview_windows(v, count).orderBy("k").collect()]

    assert windows(4500, 25, 20)[:3] == [(100, 125), (325, 350), (550, 575)] and windows(4500, 25, 20)[-1] == (4375, 4400)
    assert windows(100, 25, 4) == [(0, 25), (25, 50), (50, 75), (75, 100)]
    frames = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "video_id int, i int, sharpness double")
    w = preview.preview_windows(spark.createDataFrame([(1, 10, 25.0)], "video_id int, frame_count int, fps double"), 20)
    assert sorted(r.frame for r in preview.quick_preview(frames, w).collect()) == list(range(10))


def test_timecode(spark):
    rows = spark.createDataFrame([(x,) for x in ["1:15:36", "15:36", "36", "1:75:00", "1:15:36.5", "", "1:2:3:4", "a", "-5", None]], "s string")
    assert [r[0] for r in rows.select(timecode.parse_timestamp(F.col("s"))).collect()] == [4536, 936, 36, 8100, 4536.5, None, None, None, None, None]
    rows = spark.createDataFrame([(x,) for x in [4536.5, 36.0, -1.0, 59.9996]], "s double")
    assert [r[0] for r in rows.select(timecode.format_timestamp(F.col("s"))).collect()] == ["1:15:36.500", "00:36.000", "00:00.000", "01:00.000"]


def test_names(spark):
    rows = spark.createDataFrame([("clip", 3, 880, 42), ("clip", None, 7, None)], "stem string, scene int, frame int, seed int")
    made = [r[0] for r in rows.select(names.still_name(*(F.col(c) for c in rows.columns))).collect()]
    assert made == ["clip_s003_f000880_seed42.png", "clip_sxxx_f000007.png"]
    rows = spark.createDataFrame([(x,) for x in ["clip_s003_f000880_seed42_upscaled.png", "a_s01_f02_s003_f000880.png", "clip_sxxx_f000007.png"]], "n string")
    assert [tuple(r[0]) for r in rows.select(names.parse_still_name(F.col("n"))).collect()] == [(3, 880, 42), (1, 2, None), (None, None, None)]


def test_hashes(spark):
    rows = spark.createDataFrame([("ffffffffffffffff", "0" * 16), ("8000000000000001", "0000000000000001")], "a string, b string")
    assert [r[0] for r in rows.select(hamming(hex_to_long(F.col("a")), hex_to_long(F.col("b")))).collect()] == [64, 1]
    assert pixels.difference_hash(np.tile(np.arange(9, dtype=np.uint8), (8, 1))) == "f" * 16
    assert pixels.difference_hash(np.zeros((8, 9), np.uint8)) == "0" * 16
    a, b = np.zeros((1, 1, 3)), np.zeros((1, 1, 3))
    a[..., 0], b[..., 0] = 5, 175
    assert round(pixels.scene_score(a, b), 4) == 3.3333


def test_quota(spark):
    o = selection.Options(fps=25.0)
    spans = [2, 6, 7, 10, 14, 35]
    spans_ = spark.createDataFrame([(1, k, 1000 * k, 1000 * k + 25 * s - 1) for k, s in enumerate(spans)], "video_id int, scene int, start int, end int")
    frames = spans_.select("video_id", "scene", F.explode(F.sequence("start", "end")).alias("pos")).withColumns({"i": F.col("pos"), "sharpness": F.lit(1.0), "luma": F.lit(99.0), "highlight_frac": F.lit(0.0)})
    judged = selection.judge_frames(frames, o)
    assert [r.quota for r in selection.scene_quota(judged, o).orderBy("scene").collect()] == [1, 2, 2, 2, 4, 8]
    assert selection.scene_gap(judged, o).filter("scene = 5").first().gap == 21
    dark = selection.judge_frames(frames.withColumn("luma", F.when(F.col("scene") == 1, 1.0).otherwise(99.0)), o)
    assert selection.select_stats(dark, o).first().scenes_unusable == [1] and selection.scene_quota(dark, o).count() == 5


def test_selection_reads_its_frames_twice_at_most(spark, sf):
    """Once for scene bounds, once for what is chosen by them; scene facts are windows on the same shuffle."""
    from stillflow.plans.registry import QUERIES

    for name, scans in (("select_scene", 2), ("slice_candidates", 2), ("weak_frames", 2), ("sharpest_per_interval", 2), ("restore_window", 3)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan parquet") <= scans, name


def test_closest_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(v, int(f), int(h)) for v in (1, 2) for f, h in zip(rng.permutation(40), rng.integers(-(2**63), 2**63 - 1, 40), strict=True)] + [(3, 1, 1)]
    got = {r.video_id: (r.d, r.fa, r.fb) for r in selection.closest_pairs(spark.createDataFrame(rows, "video_id long, frame int, dhash long")).collect()}
    for v in (1, 2):
        some = sorted((f, h) for w, f, h in rows if w == v)
        assert got[v] == min((bin((h ^ k) & (2**64 - 1)).count("1"), f, g) for f, h in some for g, k in some if f < g)
    assert set(got) == {1, 2}


def test_segments_hold_frames_with_gaps(spark):
    """Segments that begin or end at frames that are missing, or hold none."""
    frames = spark.createDataFrame([(v, i, 9.0) for v in (1, 2) for i in range(0, 40, 3)], "video_id int, i int, delta double")
    parts = spark.createDataFrame([(1, 0, 4, 8), (1, 1, 10, 11), (1, 2, 20, 31), (2, 0, 38, 90)], "video_id int, seg int, start int, stop int")
    got = [(r.video_id, r.seg, r.i, r.pos, r.delta) for r in scenes.in_segments(frames, parts).orderBy("video_id", "i").collect()]
    assert got == [(1, 0, 6, 0, 0.0), (1, 2, 21, 1, 0.0), (1, 2, 24, 2, 9.0), (1, 2, 27, 3, 9.0), (1, 2, 30, 4, 9.0), (2, 0, 39, 0, 0.0)]


def test_kernels_by_hand():
    assert pixels.laplacian_variance(np.array([[0, 0, 0], [0, 9, 0], [0, 0, 0]], np.uint8)) == np.var([[0, 18, 0], [18, -36, 18], [0, 18, 0]])
    assert pixels.laplacian_variance(np.array([[7]], np.uint8)) == 0.0
    colours = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [0, 255, 255], [128, 128, 128], [0, 0, 0], [64, 0, 128]]], np.uint8)
    assert pixels.to_hsv(colours)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [30, 255, 255], [0, 0, 128], [0, 0, 0], [165, 255, 128]]
    assert pixels.to_gray(colours)[0].tolist() == [76, 150, 29, 226, 128, 0, 46]
    ramp = np.arange(0, 80, 10, dtype=np.uint8).reshape(1, 8)
    assert pixels.bilinear_resize(ramp, 4, 1).tolist() == [[5, 25, 45, 65]] and pixels.bilinear_resize(ramp, 8, 1).tolist() == ramp.tolist()
    assert pixels.area_resize(ramp, 2, 1).tolist() == [[15.0, 55.0]] and pixels.area_resize(ramp[:, :3], 2, 1).tolist() == [[10 / 3, 50 / 3]]
    assert pixels.crop(np.arange(12).reshape(3, 4), (1, 1, 2, 2)).tolist() == [[5, 6], [9, 10]]
    assert pixels.content_box(np.array([[0, 0, 0], [0, 20, 0], [0, 99, 17]])) == (1, 1, 2, 2) and pixels.content_box(np.zeros((2, 3))) == (0, 0, 3, 2)


@pytest.fixture(scope="module")
def sequence(tmp_path_factory):
    """60 pictures of 96 x 64 with bars of 8 pixels on the left and right, and a cut at 30."""
    folder, rng = tmp_path_factory.mktemp("sequence"), np.random.default_rng(2)
    for i in range(60):
        picture = np.zeros((64, 96, 3), np.uint8)
        picture[:, 8:88] = ((200, 60, 40) if i < 30 else (30, 90, 220)) + rng.integers(0, 20, (64, 80, 3))
        (folder / f"p{i:03d}.png").write_bytes(images.png_bytes(picture))
    return str(folder)


def test_png_sequence_end_to_end(spark, sequence):
    frames = images.png_frames(spark, sequence)
    assert frames.count() == 60
    box = images.content_boxes(frames).first()
    assert (box.x, box.y, box.w, box.h) == (8, 0, 80, 64)
    some = [images.measure(frames, (8, 0, 80, 64), chunk).orderBy("i").collect() for chunk in (7, 60)]
    assert some[0] == some[1]
    metrics = spark.createDataFrame(some[1])
    bounds = scenes.scene_bounds(scenes.with_position(metrics)).orderBy("id").collect()
    assert [(r.start, r.end) for r in bounds] == [(0, 29), (30, 59)]
    chosen = spark.createDataFrame([(sequence, 10), (sequence, 0)], "video_id string, frame int")
    windows = {r.frame: r for r in restore.restore_windows(chosen, frames, ["data", "height", "width"]).collect()}
    assert windows[10].complete and not windows[0].complete
    stack = np.stack([np.frombuffer(m.data, np.uint8).reshape(m.height, m.width, 3) for m in windows[10].members])
    assert (restore.Centre().restore(stack) == stack[2]).all()
    assert restore.Median().restore(stack).shape == restore.Mean().restore(stack).shape == (64, 96, 3)
    assert restore.Mean().restore(stack, resolution=32).shape == (32, 48, 3)
    with pytest.raises(ValueError):
        restore.Centre().restore(stack[:4])
    with pytest.raises(RuntimeError):
        restore.External().restore(stack)
    for model, unknown in ((restore.Mean(), {"seed": 1}), (restore.External(seed_tint()), {"cfg": 1})):
        with pytest.raises(TypeError):
            model.restore(stack, **unknown)


def seed_tint():
    """A factory, made where it is called, so that workers need no module of the tests."""

    class SeedTint:
        """A model for tests: the middle frame, its red set to the seed, its green to ten times cfg_scale."""

        def __init__(self, **options):
            self.options = options

        def restore(self, frames, seed, cfg_scale, **parameters):
            assert sorted(parameters) == ["color_correction", "input_noise_scale", "latent_noise_scale", "resolution"]
            out = frames[len(frames) // 2].copy()
            out[..., 0], out[..., 1] = seed, int(10 * cfg_scale)
            return out

    return SeedTint


def test_a_source_of_thirty_frames_a_second(spark, sequence):
    from stillflow import pipeline

    made = pipeline.scan(spark, sequence, fps=30.0, segments=[(0.5, 1.5)])
    assert made["video"]["fps"] == 30.0 and [f["i"] for f in made["frames"]] == list(range(15, 46)) and made["frames"][0]["t"] == 0.5
    # What the frames say holds, not the default.
    frames = images.png_frames(spark, sequence, 30.0)
    assert images.measure(frames).filter("i = 45").first().t == 1.5
    chosen = pipeline.select(spark, made, interval=0.5, min_luma=0)
    assert all(p["t"] == round(p["frame"] / 30, 4) for p in chosen["picks"]) and chosen["select"]["closest_pair"]["frames"]


@pytest.mark.parametrize("method", [restore.Mean(), restore.Median(), restore.Centre(), restore.External(seed_tint())])
def test_seeds_with_each_method(spark, sequence, tmp_path, method):
    from stillflow import pipeline

    options = {"interval": 1.2, "min_luma": 0, "seeds": 2, "seed": 7, "restorer": method}
    if not method.takes_seed:
        with pytest.raises(ValueError, match="every seed"):
            pipeline.run(spark, sequence, str(tmp_path), **options)
        with pytest.raises(ValueError, match="every seed"):
            pipeline.restore_folder(spark, sequence, method, 9, seeds=2)
        return
    done = pipeline.run(spark, sequence, str(tmp_path), parameters={"cfg_scale": 3.0}, layout={"columns": 2, "quality": 60}, **options)
    assert {f.split("_seed")[1] for f in done["written"]} == {"7.png", "8.png"}
    made = json.loads((tmp_path / "manifest.json").read_text())
    assert made["restore_params"] == {"method": "external", **restore.PARAMETERS, "cfg_scale": 3.0, "seed": 7, "seeds": 2}
    got = {r.file.rsplit("/", 1)[1]: r.data for r in spark.read.format("image").load(str(tmp_path / "stills")).select("image.origin", "image.data").toDF("file", "data").collect()}
    assert all(set(data[1::3]) == {30} and set(data[2::3]) == {int(f.split("_seed")[1][0])} for f, data in got.items())
    # Nothing to do: what was said of the stills stays.
    assert pipeline.run(spark, sequence, str(tmp_path), parameters={"cfg_scale": 3.0}, **options)["written"] == []
    assert json.loads((tmp_path / "manifest.json").read_text())["restore_params"] == made["restore_params"]


def test_errors_stay_with_their_stills(spark, sequence, tmp_path):
    from stillflow import pipeline

    class Picky(restore.Centre):
        def merge(self, frames):
            if frames.mean(axis=(0, 1, 2))[0] > 100:  # red, as in the second scene
                raise ValueError("too red")
            return super().merge(frames)

    with pytest.raises(RuntimeError, match="of 2 stills failed.*too red"):
        pipeline.run(spark, sequence, str(tmp_path), interval=1.2, restorer=Picky(), min_luma=0)
    assert len([p for p in (tmp_path / "stills").iterdir() if p.name.endswith(".png")]) == 1


def test_restoring_a_folder(spark, sequence, tmp_path):
    from stillflow import cli

    out = str(tmp_path / "one.png")
    assert cli.main(["restore", sequence, "--window", "9", "--crop_pillarbox", "--method", "mean", "--out", out]) == 0
    size = spark.read.format("image").load(out).select("image.width", "image.height").first()
    assert tuple(size) == (80, 64)
    assert cli.main(["restore", sequence, "--window", "5", "--resolution", "32", "--method", "median", "--out", out, "--quiet"]) == 0
    assert tuple(spark.read.format("image").load(out).select("image.width", "image.height").first()) == (48, 32)
    with pytest.raises(SystemExit, match="does not take cfg_scale"):
        cli.main(["restore", sequence, "--method", "mean", "--cfg_scale", "2"])
    with pytest.raises(SystemExit):
        cli.main(["restore", sequence, "--color_correction", "sepia"])


def test_contact_sheet(spark, sequence, tmp_path):
    files = spark.read.format("binaryFile").load(sequence + "/p00[0-3].png").select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")
    rows = files.withColumns({"sheet": F.lit(0), "width": F.lit(96), "height": F.lit(64), "frame": F.lit(1), "t": F.lit(0.5), "scene": F.lit(None).cast("int"), "seed": F.lit(None).cast("int"), "variant": F.lit(None).cast("string"), "window": F.array(F.lit(1), F.lit(5)), "source_frames": F.sequence(F.lit(1), F.lit(5))})
    first, second = sheet.labels()
    cells = sheet.sheet_layout(rows, ["file"], columns=3).withColumns({"first": first, "second": second})
    out = [r.asDict() for r in cells.orderBy("ordinal").collect()]
    assert out[1]["first"] == "#01  f1  0.50s" and out[1]["second"] == "from 5 frames [1..5]   96x64"
    sheet.render_sheet(spark, out, (out[0]["sheet_w"], out[0]["sheet_h"]), str(tmp_path / "sheet.jpg"), "four")
    read = spark.read.format("image").load(str(tmp_path / "sheet.jpg")).select("image.width", "image.height").first()
    assert tuple(read) == (3 * 420, 52 + 2 * (280 + 62)) and [p.name for p in tmp_path.iterdir()] == ["sheet.jpg"]
    sheet.render_sheet(spark, out, (out[0]["sheet_w"], out[0]["sheet_h"]), str(tmp_path / "low.jpg"), "four", quality=20)
    assert (tmp_path / "low.jpg").stat().st_size < (tmp_path / "sheet.jpg").stat().st_size
    with pytest.raises(ValueError):
        sheet.render_sheet(spark, [], (1, 1), "none.jpg")


def test_resume_and_curation(spark):
    wanted = spark.createDataFrame([("a_s000_f000001.png",), ("a_s000_f000002.png",), ("a_s000_f000003.png",)], "file string")
    present = spark.createDataFrame([("a_s000_f000001.png", None), ("a_s000_f000002.png", False)], "file string, restored boolean")
    state = lambda **k: [r.state for r in stills.resume_todo(wanted, present, **k).orderBy("file").collect()]
    assert state() == ["done", "stale", "todo"] and state(restoring=False) == ["done", "done", "todo"] and state(force=True) == ["todo"] * 3
    files = spark.createDataFrame([(x,) for x in ["a_s000_f000001.png", "a_s000_f000001_upscaled.png", "a_s000_f000002.png", "a_s000_f000009.png", "junk.png", "a_s000_f000004.png"]], "file string")
    picks_ = spark.createDataFrame([(1,), (2,), (4,)], "frame int")
    prior = spark.createDataFrame([("a_s000_f000004.png", True), ("a_s000_f000002.png", False)], "file string, restored boolean")
    kept = {r.file: r.state for r in stills.kept_stills(files, picks_, prior).collect()}
    assert kept == {"a_s000_f000001.png": "present", "a_s000_f000001_upscaled.png": "upscaled", "a_s000_f000002.png": "todo", "a_s000_f000009.png": "orphan", "junk.png": "orphan", "a_s000_f000004.png": "done"}


def test_documents(spark, tmp_path):
    scan = {"scan_version": 4, "video": {"filename": "a.mp4", "fps": 25.0}, "frames": [{"i": 0, "t": 0.0, "sharpness": 1.5}, {"i": 1, "t": 0.04, "sharpness": 2.5}]}
    documents.write_document(scan, str(tmp_path / "scan.json"))
    assert [r.sharpness for r in documents.scan_frames(documents.read_scan(spark, str(tmp_path / "scan.json"))).collect()] == [1.5, 2.5]
    documents.write_document(scan | {"scan_version": 3}, str(tmp_path / "old.json"))
    with pytest.raises(Exception, match="scan_version"):
        documents.read_scan(spark, str(tmp_path / "old.json")).collect()
    made = documents.build_manifest([{"file": "a.png", "frame": 1, "restored": False, "path": "x"}, {"file": "b.png"}], restore_params={"seed": 42})
    assert made["still_count"] == 2 and made["stills"][0] == {"file": "a.png", "frame": 1, "restored": False}
    documents.write_document(made, str(tmp_path / "manifest.json"))
    assert {r.file: r.restored for r in documents.prior_restored(documents.read_manifest(spark, str(tmp_path / "manifest.json"))).collect()} == {"a.png": False, "b.png": True}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["manifest.json", "old.json", "scan.json"] and json.loads((tmp_path / "scan.json").read_text()) == scan


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# a comment\nSTILLFLOW_FACTORY = 'mine:made'\n\nEMPTY=\nnothing\n  INDENTED=a=b\nOVER=file\n")
    monkeypatch.setenv("OVER", "environment")
    got = documents.read_settings(str(tmp_path / ".env"))
    assert got["STILLFLOW_FACTORY"] == "mine:made" and got["INDENTED"] == "a=b" and got["OVER"] == "environment" and "EMPTY" not in got and "nothing" not in got
    assert "STILLFLOW_FACTORY" not in documents.read_settings(str(tmp_path / "none"))


def test_video_source(spark, tmp_path):
    assert video.frame_ranges(0, 450, 8) == [(0, 112), (112, 225), (225, 337), (337, 450)] and video.frame_ranges(0, 99, 8) == [(0, 99)]
    for name in ("A.MP4", "b.mkv", "note.txt"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in images.list_videos(spark, str(tmp_path)).collect()] == ["A.MP4", "b.mkv"]
    video.register(spark)
    with pytest.raises(Exception, match="OpenCV|cannot open"):
        spark.read.format("frames_of_video").option("path", str(tmp_path / "b.mkv")).load().collect()


def test_streams(spark, tmp_path):
    rows = made_up().assign(ts=pd.to_datetime("2024-01-01") + pd.to_timedelta(made_up()["t"], unit="s"), pos=np.arange(300))[["video_id", "i", "pos", "delta", "sharpness", "ts"]]
    schema = "video_id long, i long, pos long, delta double, sharpness double, ts timestamp"
    for k, part in enumerate(np.array_split(np.arange(300), 3)):
        spark.createDataFrame(rows.iloc[part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}").collect()

    assert sorted(r.frame for r in run(streams.interval_picks(stream()), "picked", "complete")) == [30, 60, 131, 161, 232, 262]
    closed = run(streams.closed_scenes(stream(), 27.0, 15), "closed", "append")
    assert sorted((r.start, r.end) for r in closed) == [(0, 99), (100, 199), (200, 294)]


@pytest.mark.parametrize("bad", [0.05, 0.25])
def test_intervals_are_checked(bad):
    with pytest.raises(ValueError):
        selection.check_interval(bad)


def test_windows_are_checked():
    with pytest.raises(ValueError):
        selection.Options(fps=25.0, window=7)


def test_run_resumes(spark, sequence, tmp_path):
    from stillflow import cli, pipeline

    out = str(tmp_path / "out")
    first = pipeline.run(spark, sequence, out, seconds_per_still=0.4, min_luma=0, hash_distance=0)
    assert len(first["written"]) == first["stills"] >= 4
    assert pipeline.run(spark, sequence, out, seconds_per_still=0.4, min_luma=0, hash_distance=0) == {"written": [], "stills": first["stills"]}
    options = {"seconds_per_still": 0.4, "min_luma": 0, "hash_distance": 0}
    with pytest.raises(RuntimeError, match="captures"):
        pipeline.run(spark, sequence, out, restorer=restore.Mean(), **options)
    (tmp_path / "out" / "stills" / first["written"][0]).unlink()
    up = pipeline.run(spark, sequence, out, restorer=restore.Mean(), upscale=True, **options)
    assert up["written"] == [f.replace(".png", "_upscaled.png") for f in first["written"][1:]] and up["stills"] == 2 * len(up["written"])
    made = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert {s["file"]: s["restored"] for s in made["stills"]} == {f: "_upscaled" in f for f in first["written"][1:] + up["written"]} and all(s["width"] == 80 for s in made["stills"])
    assert pipeline.run(spark, sequence, out, restorer=restore.Mean(), upscale=True, **options)["written"] == []
    assert len(pipeline.run_quick_preview(spark, sequence, out, 6)) == 6
    assert names.parse_still_name is not None and not any("_s0" in p.name for p in (tmp_path / "out" / "preview").iterdir())
    assert list(pipeline.run_folder(spark, [sequence, str(tmp_path / "none")], str(tmp_path / "all"), interval=1.0).values())[0] == "done"
    assert cli.main(["doctor"]) == 0 and cli.main(["doctor", "--factory", "nowhere:nothing"]) == 1


def test_reports_of_commands(spark, sequence, tmp_path, capsys):
    from stillflow import cli

    scan, chosen = str(tmp_path / "a.scan.json"), str(tmp_path / "a.select.json")
    assert cli.main(["scan", sequence, "--out", scan, "--show_scenes", "1", "--workers", "2"]) == 0
    said = capsys.readouterr().out
    assert "60 frames, 96x64 at 25 a second, 2.4 s" in said and "content 80x64 at (8, 0), 16.7 % bars" in said and "scene 0:" in said and "and 1 more" in said
    assert cli.main(["select", scan, "--seconds_per_still", "0.4", "--min_luma", "0", "--hash_distance", "0"]) == 0
    said = capsys.readouterr().out
    assert "eligible frames" in said and "closest pair" in said and "quota by scene" in said
    assert cli.main(["run", sequence, "--out", str(tmp_path / "out"), "--preview", "3", "--interval", "0.8", "--min_luma", "0"]) == 0
    assert (tmp_path / "out" / "work" / "scan.json").exists() and "stills written" in capsys.readouterr().out
    folder = tmp_path / "out" / "stills"
    (folder / "odd.png").write_bytes(next(p for p in folder.iterdir() if p.name.endswith(".png")).read_bytes())
    assert cli.main(["sheet", str(folder), "--selection", chosen, "--quality", "40", "--title", "mine", "--columns", "2", "--manifest", str(tmp_path / "m.json")]) == 0
    said = capsys.readouterr().out
    assert "warning: 1 stills do not tell their frame by name: odd.png" in said and "4 stills" in said
    assert cli.main(["scan", sequence, "--out", scan, "--quiet", "--no_content_box"]) == 0 and capsys.readouterr().out == ""
    made = json.loads(open(scan).read())
    assert made["content_box"] == {"x": 0, "y": 0, "w": 96, "h": 64}
    with pytest.raises(SystemExit):
        cli.main(["sheet", str(folder), "--selection", scan])
    assert cli.configured(["run", "--min_luma=24", "--out", "x", "--columns", "2"]) == {"min_luma"}
