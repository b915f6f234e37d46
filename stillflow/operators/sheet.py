"""Contact sheets: layout and labels in the plan; the picture itself through the JVM's imaging classes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS, THUMB_WIDTH, QUALITY = 5, 420, 92
BACKGROUND, TEXT, DIM = 24, 235, 150


def sheet_sizes(stills: DataFrame, columns: int = COLUMNS, thumb_width: int = THUMB_WIDTH, title: bool = True, keys: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """For each sheet (keys) of stills (width, height): cell, label and title sizes; the median shape sets the cells."""
    s = thumb_width / 420.0
    line_h, pad, title_h = int(26 * s), int(10 * s), int(52 * s) if title else 0
    sizes = stills.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.median(F.col("height") / F.col("width")).alias("aspect"))
    cols = F.greatest(F.lit(1), F.least(F.lit(columns), "n"))
    sizes = sizes.withColumns({"columns": cols, "cell_w": F.lit(thumb_width), "cell_h": F.bround(F.col("aspect") * thumb_width).cast("int"), "label_h": F.lit(2 * line_h + pad), "title_h": F.lit(title_h)})
    sizes = sizes.withColumn("rows", F.ceil(F.col("n") / F.col("columns")).cast("int"))
    return sizes.withColumns({"sheet_w": F.col("columns") * F.col("cell_w"), "sheet_h": F.col("title_h") + F.col("rows") * (F.col("cell_h") + F.col("label_h"))})


def sheet_layout(stills: DataFrame, order: list[str], keys: tuple[str, ...] = ("sheet",), **options) -> DataFrame:
    """stills and ordinal, row, col, x0, y0 of their cells, and the fitted picture: fit_w, fit_h, fit_x, fit_y."""
    sizes = sheet_sizes(stills, keys=keys, **options)
    placed = stills.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int")).join(sizes.drop("n", "aspect"), list(keys))
    placed = placed.withColumns({"row": F.floor(F.col("ordinal") / F.col("columns")).cast("int"), "col": (F.col("ordinal") % F.col("columns")).cast("int")})
    placed = placed.withColumns({"x0": F.col("col") * F.col("cell_w"), "y0": F.col("title_h") + F.col("row") * (F.col("cell_h") + F.col("label_h"))})
    w, h, x, y = fit(F.col("width"), F.col("height"), F.col("cell_w"), F.col("cell_h"))
    return placed.withColumns({"fit_w": w, "fit_h": h}).withColumns({"fit_x": x, "fit_y": y})


def fit(width: Column, height: Column, cell_w: Column, cell_h: Column) -> tuple[Column, Column, Column, Column]:
    """Size of a picture scaled into a cell (fractions cut, 1 at least), and its place in the middle (of fit_w, fit_h)."""
    scale = F.least(cell_w / width, cell_h / height)
    size = lambda v: F.greatest(F.lit(1), F.floor(v * scale).cast("int"))
    return size(width), size(height), F.floor((cell_w - F.col("fit_w")) / 2).cast("int"), F.floor((cell_h - F.col("fit_h")) / 2).cast("int")


def labels() -> tuple[Column, Column]:
    """The two lines under a still, from ordinal, frame, t, scene, variant, seed, source_frames, window, width, height; what is null is left out."""
    first = F.concat_ws("  ", F.format_string("#%02d", "ordinal"), F.concat(F.lit("f"), F.col("frame").cast("string")), F.when(F.col("t").isNotNull(), F.format_string("%.2fs", "t")), F.concat(F.lit("scene "), F.col("scene").cast("string")))
    span = F.when(F.size("source_frames") > 0, F.format_string("from %d frames [%d..%d]", F.size("source_frames"), F.col("window")[0], F.col("window")[1]))
    second = F.concat_ws("   ", "variant", F.concat(F.lit("seed "), F.col("seed").cast("string")), span, F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))
    return first, second


def render_sheet(spark: SparkSession, cells: list[dict], size: tuple[int, int], path: str, title: str | None = None, quality: int = QUALITY) -> None:
    """A JPEG of placed cells (bytes of a picture file, x0, y0, fit_*, first, second): one sheet, so its cells fit the driver."""
    if not cells:
        raise ValueError("no stills to lay out")
    jvm = spark._jvm
    awt, io = jvm.java.awt, jvm.javax.imageio
    image = awt.image.BufferedImage(size[0], size[1], awt.image.BufferedImage.TYPE_INT_RGB)
    g = image.createGraphics()
    g.setColor(awt.Color(BACKGROUND, BACKGROUND, BACKGROUND))
    g.fillRect(0, 0, size[0], size[1])
    if title:
        g.setColor(awt.Color(TEXT, TEXT, TEXT))
        g.drawString(title, 10, 34)
    for c in cells:
        picture = io.ImageIO.read(jvm.java.io.ByteArrayInputStream(c["content"]))
        if picture is None:
            raise OSError(f"cannot read still: {c.get('file')}")
        g.drawImage(picture, c["x0"] + c["fit_x"], c["y0"] + c["fit_y"], c["fit_w"], c["fit_h"], None)
        y = c["y0"] + c["cell_h"] + 20
        for text, level, dy in ((c["first"], TEXT, 0), (c["second"], DIM, 22)):
            g.setColor(awt.Color(level, level, level))
            g.drawString(text, c["x0"] + 10, y + dy)
    g.dispose()
    writer = io.ImageIO.getImageWritersByFormatName("jpg").next()
    setting = writer.getDefaultWriteParam()
    setting.setCompressionMode(io.ImageWriteParam.MODE_EXPLICIT)
    setting.setCompressionQuality(quality / 100)
    # The file appears whole: under a name that no listing takes first.
    part = jvm.java.io.File(path + ".part")
    part.delete()
    stream = io.ImageIO.createImageOutputStream(part)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(image, None, None), setting)
    stream.close()
    writer.dispose()
    os.replace(path + ".part", path)
