"""python -m stillflow.cli doctor | scan | select | sheet | restore | run"""

from __future__ import annotations

import argparse
import json
import os
import sys

from stillflow.functions.names import VIDEO_EXTENSIONS
from stillflow.operators.restore import PARAMETERS, SEED

# Names and defaults of the options that choose frames.
SELECT_OPTIONS = {"window": (int, 5), "seconds_per_still": (float, 4.0), "per_scene_max": (int, 8), "hash_distance": (int, 8), "min_gap": (float, 0.4), "gap_fraction": (float, 0.2), "min_sharpness_frac": (float, 0.35), "min_luma": (float, 24.0), "max_highlight_frac": (float, 0.20)}
# Options that a quick preview has no use for: where one is given, the preview goes through scan and selection.
SCAN_OPTIONS = ("fps", "scene_threshold", "min_scene_len", "no_content_box", "workers", "segment")
CORRECTIONS = ("lab", "wavelet", "wavelet_adaptive", "hsv", "adain", "none")


def _seconds(text: str) -> float:
    parts = text.strip().split(":")
    values = [float(p) for p in parts]
    if len(parts) > 3 or min(values) < 0:
        raise argparse.ArgumentTypeError(f"not a time: {text}")
    return sum(v * 60**k for k, v in enumerate(reversed(values)))


def _count(text: str) -> int:
    if not text.isdigit() or not int(text):
        raise argparse.ArgumentTypeError(f"not a number of frames: {text}")
    return int(text)


def _session(quiet: bool = False):
    """Spark's own progress bar tells how far a run is, unless it is to be quiet."""
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("stillflow").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", str(not quiet).lower()).getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stillflow")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("doctor", help="what is there and what is missing; fails if something needed is")
    p.add_argument("--factory", help="module:name of what makes a restoration model (by default what STILLFLOW_FACTORY says, in .env or the environment): does it make one?")

    def scanning(p):
        p.add_argument("--fps", type=float, default=25.0, help="frames a second of picture folders; videos have their own")
        p.add_argument("--scene_threshold", type=float, default=27.0)
        p.add_argument("--min_scene_len", type=int, default=15)
        p.add_argument("--no_content_box", action="store_true")
        p.add_argument("--workers", type=int, help="ranges of frames that a video is read in")
        p.add_argument("--segment", nargs=2, type=_seconds, action="append", metavar=("FROM", "TO"))

    def selecting(p):
        p.add_argument("--interval", type=float, default=0.0)
        for name, (kind, default) in SELECT_OPTIONS.items():
            p.add_argument(f"--{name}", type=kind, default=default)

    def restoring(p, methods, default):
        p.add_argument("--method", choices=methods, default=default)
        p.add_argument("--factory", help="module:name of what makes the model of method external")
        p.add_argument("--seed", type=int, default=SEED)
        p.add_argument("--seeds", type=int, default=1)
        for name, value in PARAMETERS.items():
            p.add_argument(f"--{name}", type=type(value), choices=CORRECTIONS if name == "color_correction" else None, help=f"default {value}, where the method takes it")
        p.add_argument("--attention_mode", choices=("sdpa", "flash_attn_2", "flash_attn_3", "sageattn_2", "sageattn_3"))
        p.add_argument("--vae_encode_tiled", action="store_true", default=None)
        p.add_argument("--no_decode_tiling", action="store_true", default=None)
        p.add_argument("--blocks_to_swap", type=int)

    def laying(p):
        p.add_argument("--columns", type=int, default=5)
        p.add_argument("--thumb_width", type=int, default=420)
        p.add_argument("--quality", type=int, default=92)

    p = commands.add_parser("scan", help="metric rows, scenes and content box of a video or a folder of PNG files")
    p.add_argument("input")
    p.add_argument("--out")
    p.add_argument("--show_scenes", type=int, default=20)
    p.add_argument("--quiet", action="store_true")
    scanning(p)
    p = commands.add_parser("select", help="frames of a scan")
    p.add_argument("scan")
    p.add_argument("--out")
    selecting(p)
    p = commands.add_parser("sheet", help="contact sheet and manifest of a folder of stills")
    p.add_argument("stills")
    p.add_argument("--selection")
    p.add_argument("--out")
    p.add_argument("--manifest")
    p.add_argument("--title")
    laying(p)
    p = commands.add_parser("restore", help="one still of a window of PNG files")
    p.add_argument("folder")
    p.add_argument("--out")
    p.add_argument("--window", type=int, default=0)
    p.add_argument("--crop_pillarbox", action="store_true")
    p.add_argument("--quiet", action="store_true")
    restoring(p, ("centre", "mean", "median", "external"), "centre")
    p = commands.add_parser("run", help="all stages of a video, a folder of PNG files, or each video of a folder")
    p.add_argument("input")
    p.add_argument("--out")
    p.add_argument("--force", action="store_true")
    p.add_argument("--quiet", action="store_true")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--preview", nargs="?", const=20, type=_count)
    how.add_argument("--upscale-stills", action="store_true")
    restoring(p, ("capture", "mean", "median", "external"), "capture")
    scanning(p)
    selecting(p)
    laying(p)
    return top


def configured(argv: list[str]) -> set[str]:
    """Options for scan and selection that were written out, at their default or not."""
    return {a.split("=", 1)[0].lstrip("-") for a in argv if a.startswith("--")} & {*SCAN_OPTIONS, "interval", *SELECT_OPTIONS}


def model_of(a: argparse.Namespace):
    """The restorer that the options ask for, and its parameters."""
    from stillflow.operators import restore

    parameters = {k: getattr(a, k) for k in PARAMETERS if getattr(a, k) is not None}
    worker = {"attention_mode": a.attention_mode, "encode_tiled": a.vae_encode_tiled, "decode_tiled": None if a.no_decode_tiling is None else False, "blocks_to_swap": a.blocks_to_swap}
    if a.method == "external":
        return restore.External(a.factory, **{k: v for k, v in worker.items() if v is not None}), parameters
    unfit = [k for k in parameters if k != "resolution"] + [k for k, v in worker.items() if v is not None]
    if a.method == "capture" and parameters:
        unfit = [*unfit, "resolution"]
    if unfit:
        sys.exit(f"method {a.method} does not take {', '.join(dict.fromkeys(unfit))}")
    return {"capture": None, "centre": restore.Centre(), "mean": restore.Mean(), "median": restore.Median()}[a.method], parameters


def doctor(factory: str | None) -> int:
    """Prints what is there; 1 if something needed is missing."""
    bad = 0
    for name in ("pyspark", "numpy", "pandas", "pyarrow", "cv2"):
        try:
            print(f"{name}: {getattr(__import__(name), '__version__', 'there')}")
        except ImportError:
            needed = name != "cv2"
            bad += needed
            print(f"{name}: missing" + ("" if needed else " (only reading videos needs it)"))
    if factory:
        from stillflow.operators.restore import External

        try:
            print(f"{factory}: makes {type(External(factory)._made()).__name__}")
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{factory}: {type(error).__name__}: {error}")
    return int(bad > 0)


def scan_report(made: dict, show: int) -> list[str]:
    v, box = made["video"], made["content_box"]
    matte = 100 * (1 - box["w"] * box["h"] / (v["width"] * v["height"]))
    out = [f"{v['filename']}: {v['frame_count']} frames, {v['width']}x{v['height']} at {v['fps']:g} a second, {v['duration_s']:g} s", f"content {box['w']}x{box['h']} at ({box['x']}, {box['y']}), {matte:.1f} % bars", f"{len(made['scenes'])} scenes"]
    out += [f"scene {s['id']}: frames {s['start_i']} to {s['end_i']}, {s['frame_count']} in all, best {s['best_frame']} (sharpness {s['best_sharpness']:.1f})" for s in made["scenes"][:show]]
    left = len(made["scenes"]) - show
    return out + ([f"and {left} more"] if left > 0 else [])


def selection_report(chosen: dict) -> list[str]:
    s = chosen["select"]
    if s["mode"] == "interval":
        out = [f"{chosen['video']['filename']}: {s['selected']} picks, the sharpest frame of each {s['interval_s']:g} s, of {s['eligible_frames']} frames, window {s['window']}"]
        if s["window_unsafe"]:
            out.append(f"{s['window_unsafe']} picks are so near a cut that their window leaves the scene")
    else:
        out = [f"{chosen['video']['filename']}: {s['selected']} picks of {s['eligible_frames']} eligible frames, window {s['window']}, one for each {s['seconds_per_still']:g} s of a scene, {s['per_scene_max']} a scene at most"]
        weak = s["rejected_weak"]
        if any(weak.values()):
            out.append(f"turned down: {weak['too_soft']} too soft (below {s['min_sharpness_frac']:.0%} of their scene's best), {weak['too_dark']} too dark (below {s['min_luma']:g}), {weak['blown_highlights']} blown (more than {s['max_highlight_frac']:.0%} clipped)")
        if s["scenes_unusable"]:
            out.append(f"scenes without a usable frame: {s['scenes_unusable']}")
        if s["filled"]:
            out.append(f"{s['filled']} picks fill up scenes that came short")
        out.append(f"quota by scene: {s['scene_quota']}, gap by scene in frames: {s['scene_gap_frames']}")
    out += [f"frame {p['frame']} at {p['t']:.2f} s, scene {p['scene']}, sharpness {p['sharpness']:.1f}, window {p['window'][0]} to {p['window'][1]}" for p in chosen["picks"]]
    if "closest_pair" in s:
        pair = s["closest_pair"]
        out.append(f"closest pair: frames {pair['frames'][0]} and {pair['frames'][1]}, {pair['distance']} bits apart" + (f" ({s['hash_distance']} at least)" if "hash_distance" in s else ""))
    return out


def sheet_report(made: dict, chosen: dict | None) -> list[str]:
    """Counts of a manifest, and warnings of stills whose origin is unknown."""
    entries, out = made["stills"], []
    unnamed = [s["file"] for s in entries if "frame" not in s]
    unmatched = [s["file"] for s in entries if "frame" in s and "source_frames" not in s] if chosen else []
    for files, what in ((unnamed, "do not tell their frame by name"), (unmatched, "are of frames that the selection does not have")):
        if files:
            out.append(f"warning: {len(files)} stills {what}: {', '.join(files[:3])}{', ...' if len(files) > 3 else ''}")
    return [*out, f"{len(entries)} stills, {sum('source_frames' in s for s in entries)} with known source frames"]


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    if hasattr(a, "factory") and a.factory is None:
        from stillflow.sources.documents import read_settings

        a.factory = read_settings().get("STILLFLOW_FACTORY")
    if a.command == "doctor":
        return doctor(a.factory)
    from stillflow import pipeline
    from stillflow.sources import documents

    options = {("min_gap_s" if k == "min_gap" else k): getattr(a, k) for k in SELECT_OPTIONS if hasattr(a, k)}
    so = {"threshold": a.scene_threshold, "min_len": a.min_scene_len, "box": not a.no_content_box, "segments": a.segment, "workers": a.workers} if hasattr(a, "scene_threshold") else {}
    layout = {k: getattr(a, k) for k in ("columns", "thumb_width", "quality") if hasattr(a, k)}
    quiet = getattr(a, "quiet", False)
    model, parameters = model_of(a) if hasattr(a, "method") else (None, {})
    spark = _session(quiet)

    def say(*lines: str) -> None:
        if not quiet:
            print("\n".join(lines))

    if a.command == "scan":
        out = a.out or a.input.rstrip("/") + ".scan.json"
        made = pipeline.scan(spark, a.input, a.fps, **so)
        documents.write_document(made, out)
        say(*scan_report(made, a.show_scenes), out)
    elif a.command == "select":
        with open(a.scan, encoding="utf-8") as file:
            scanned = json.load(file)
        if scanned.get("scan_version") != documents.SCAN_VERSION:
            sys.exit(f"{a.scan} is not a scan of version {documents.SCAN_VERSION}")
        out = a.out or a.scan.removesuffix(".json").removesuffix(".scan") + ".select.json"
        chosen = pipeline.select(spark, scanned, a.interval, **options)
        documents.write_document(chosen, out)
        say(*selection_report(chosen), out)
    elif a.command == "sheet":
        chosen = None
        if a.selection:
            with open(a.selection, encoding="utf-8") as file:
                chosen = json.load(file)
            if chosen.get("select_version") != documents.SELECT_VERSION:
                sys.exit(f"{a.selection} is not a selection of version {documents.SELECT_VERSION}")
        base = a.stills.rstrip("/")
        made = pipeline.publish(spark, a.stills, chosen, a.out or f"{base}_sheet.jpg", a.manifest or f"{base}_manifest.json", title=a.title, **layout)
        say(*sheet_report(made, chosen))
    elif a.command == "restore":
        say(*pipeline.restore_folder(spark, a.folder, model, a.window, a.crop_pillarbox, a.seed, a.seeds, parameters, a.out))
    else:
        out = a.out or a.input.rstrip("/") + "_stills"
        inputs = [a.input]
        if os.path.isdir(a.input):
            inputs = sorted(os.path.join(a.input, f) for f in os.listdir(a.input) if os.path.splitext(f)[1].lower() in VIDEO_EXTENSIONS) or [a.input]
        if a.preview and not configured(argv):
            for x in inputs:
                place = out if len(inputs) == 1 else os.path.join(out, os.path.splitext(os.path.basename(x))[0])
                say(f"{x}: frames {pipeline.run_quick_preview(spark, x, place, a.preview, a.fps, layout)}")
            return 0
        more = {"fps": a.fps, "force": a.force, "restorer": None if a.preview else model, "interval": a.interval, "scan_options": so, "seeds": a.seeds, "upscale": a.upscale_stills, "seed": a.seed, "parameters": parameters, "layout": layout}
        if len(inputs) > 1:
            status = pipeline.run_folder(spark, inputs, out, **more, **options)
            say(*(f"{k}: {v}" for k, v in status.items()))
            return int(any(v != "done" for v in status.values()))
        done = pipeline.run(spark, inputs[0], out, **more, **options)
        say(f"{len(done['written'])} stills written, {done['stills']} in all, in {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
