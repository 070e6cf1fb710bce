"""Raster operators over exploded pixels (img, y, x, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlode.functions.scalars import percent

LUMA = {"r": 0.2126, "g": 0.7152, "b": 0.0722}


def luma() -> Column:
    return F.lit(0.2126) * F.col("r") + F.lit(0.7152) * F.col("g") + F.lit(0.0722) * F.col("b")


def luma_histogram(px: DataFrame, height: int = 95) -> DataFrame:
    """img, bin, n and bar (n scaled so that the largest bin of the raster has ``height``) for all 256 bins."""
    counts = px.groupBy("img", F.round(luma()).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = px.select("img").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    full = spine.join(counts, ["img", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    most = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy("img")))
    return full.withColumn("bar", F.round(F.col("n") / most * height).cast("bigint"))


def auto_exposure(hdr: DataFrame) -> DataFrame:
    """img and the exposure that brings the geometric mean luminance to middle grey."""
    finite = ~(F.isnan("y") | F.col("y").isin(float("inf"), float("-inf")))
    total = F.sum(F.when(finite, F.log2(F.greatest("y", F.lit(0.0)) + 1e-5)))
    mean = F.pow(F.lit(2.0), F.coalesce(total, F.lit(0.0)) / F.count(F.lit(1)))
    return hdr.withColumn("y", luma()).groupBy("img").agg(mean.alias("mean")).select(
        "img", F.when(F.col("mean") > 1e-5, F.greatest(F.lit(0.01), F.least(F.lit(100.0), F.lit(0.18) / F.col("mean")))).otherwise(F.lit(1.0)).alias("exposure"))


def scene_peak(hdr: DataFrame, exposure: float = 1.0) -> DataFrame:
    """img and its peak in nits, 100 at least; 1000 where nothing is lit."""
    top = F.max(luma() * exposure)
    return hdr.groupBy("img").agg(top.alias("top")).select("img", F.when(F.col("top") > 0, F.greatest(F.lit(100.0), F.col("top") * 100)).otherwise(F.lit(1000.0)).alias("peak_nits"))


def channel_ranges(px: DataFrame, least_range: int = 5) -> DataFrame:
    """img, channel, low, high and whether the channel is flat."""
    long = px.select("img", F.explode(F.array(*[F.struct(F.lit(c.upper()).alias("channel"), F.col(c).alias("v")) for c in "rgba"])).alias("c"))
    return long.groupBy("img", F.col("c.channel").alias("channel")).agg(F.min("c.v").alias("low"), F.max("c.v").alias("high")).withColumn(
        "flat", F.col("high") - F.col("low") < least_range)


def channel_planes(px: DataFrame, least_range: int = 5) -> DataFrame:
    """img, channel, y, x, v of the channels that aren't flat."""
    long = px.select("img", "y", "x", F.explode(F.array(*[F.struct(F.lit(c.upper()).alias("channel"), F.col(c).alias("v")) for c in "rgba"])).alias("c")).select(
        "img", "c.channel", "y", "x", "c.v")
    good = channel_ranges(px, least_range).where("not flat").select("img", "channel")
    return long.join(good, ["img", "channel"], "left_semi")


def vfx_transparent(px: DataFrame) -> DataFrame:
    """img and whether it is transparent almost everywhere although it has colour."""
    share = F.sum((F.col("a") > 10).cast("int")) / F.count(F.lit(1))
    colour = F.max(F.greatest("r", "g", "b")) > 0
    return px.groupBy("img").agg(((share <= 0.001) & colour).alias("vfx"))


def over_gray(px: DataFrame, gray: int = 128) -> DataFrame:
    """Colours composited over mid gray; opaque and effect rasters stay as they are."""
    flags = px.groupBy("img").agg((F.min("a") == 255).alias("opaque")).join(vfx_transparent(px), "img")
    alpha = F.col("a") / F.lit(255.0)
    mixed = lambda c: F.when(F.col("opaque") | F.col("vfx"), F.col(c)).otherwise(F.floor(F.col(c) * alpha + gray * (1 - alpha)).cast("bigint")).alias(c)
    return px.join(flags, "img").select("img", "y", "x", *[mixed(c) for c in "rgb"])


def channel_preview(px: DataFrame, channels: str) -> DataFrame:
    """One channel as gray; several with the others blanked, alpha 255 if it isn't among them."""
    if len(channels) == 1:
        v = F.col(channels.lower())
        return px.select("img", "y", "x", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).cast("bigint").alias("a"))
    keep = lambda c, other: (F.col(c) if c.upper() in channels else F.lit(other).cast("bigint")).alias(c)
    return px.select("img", "y", "x", keep("r", 0), keep("g", 0), keep("b", 0), keep("a", 255))


def _pairs(px: DataFrame, first: int, second: int) -> DataFrame:
    one = px.where(F.col("img") == first).select("y", "x", "r", "g", "b", "a")
    two = px.where(F.col("img") == second).select("y", "x", *[F.col(c).alias(f"{c}2") for c in "rgba"])
    return one.join(two, ["y", "x"])


def _gap(c: str) -> Column:
    return F.abs(F.col(c) - F.col(f"{c}2"))


def difference(px: DataFrame, first: int, second: int) -> DataFrame:
    """Absolute differences of two rasters where both have pixels."""
    return _pairs(px, first, second).select("y", "x", *[_gap(c).alias(c) for c in "rgb"], F.lit(255).cast("bigint").alias("a"))


def difference_heat(px: DataFrame, first: int, second: int) -> DataFrame:
    """The mean difference of the four channels from blue to red."""
    heat = F.floor((_gap("r") + _gap("g") + _gap("b") + _gap("a")) / 4).cast("bigint")
    long = lambda v: F.lit(v).cast("bigint")
    return _pairs(px, first, second).select("y", "x", heat.alias("r"), long(0).alias("g"), (255 - heat).alias("b"), long(255).alias("a"))


def corrected(v: Column, brightness: float, contrast: float, gamma: float) -> Column:
    """Brightness, contrast and gamma of one 8-bit value."""
    if all(abs(p - 1) < 1e-3 for p in (brightness, contrast, gamma)):
        return v
    out = (v / F.lit(255.0) * brightness - 0.5) * contrast + 0.5
    if abs(gamma - 1) >= 1e-3:
        out = F.when(out > 0, F.pow(F.greatest(out, F.lit(0.0)), F.lit(gamma))).otherwise(out)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) * 255).cast("bigint")


def correct_colors(px: DataFrame, brightness: float, contrast: float, gamma: float) -> DataFrame:
    return px.withColumns({c: corrected(F.col(c), brightness, contrast, gamma) for c in "rgb"})


def sprite(px: DataFrame, columns: int, rows: int, frame: int) -> DataFrame:
    """One cell of a sprite sheet; frames wrap around."""
    cell = frame % (columns * rows)
    size = px.groupBy("img").agg(F.floor((F.max("x") + 1) / columns).cast("bigint").alias("cw"), F.floor((F.max("y") + 1) / rows).cast("bigint").alias("ch"))
    left, top = F.col("cw") * (cell % columns), F.col("ch") * (cell // columns)
    inside = (F.col("x") >= left) & (F.col("x") < left + F.col("cw")) & (F.col("y") >= top) & (F.col("y") < top + F.col("ch"))
    return px.join(size, "img").where(inside).select("img", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "r", "g", "b", "a")


def inspect(px: DataFrame, first: int, second: int) -> DataFrame:
    """Each pixel of one raster with its hex code, its normal and its distance to the scaled place in another."""
    size = lambda img, p: px.where(F.col("img") == img).agg((F.max("x") + 1).alias(f"{p}w"), (F.max("y") + 1).alias(f"{p}h"))
    scaled = lambda v, o, d: F.least(F.round(F.col(v) * (F.col(d) / F.col(o))), F.col(d) - 1).cast("bigint")
    # One row on each side of the product: the sizes of two rasters.
    one = px.where(F.col("img") == first).crossJoin(F.broadcast(size(first, "o"))).crossJoin(F.broadcast(size(second, "d")))
    one = one.withColumns({"x2": scaled("x", "ow", "dw"), "y2": scaled("y", "oh", "dh")})
    two = px.where(F.col("img") == second).select(F.col("y").alias("y2"), F.col("x").alias("x2"), *[F.col(c).alias(f"{c}2") for c in "rgb"])
    n = {c: F.col(c) / F.lit(255.0) * 2 - 1 for c in "rgb"}
    length = F.sqrt(n["r"] * n["r"] + n["g"] * n["g"] + n["b"] * n["b"])
    unit = lambda c: (F.round(F.when(length > 1e-4, n[c] / length).otherwise(n[c]) * 100) / 100).alias({"r": "normal_x", "g": "normal_y", "b": "normal_z"}[c])
    gap = (_gap("r") + _gap("g") + _gap("b")) / F.lit(3.0)
    text = F.concat(percent(gap / 255 * 100), F.format_string(" (Δ %.0f)", F.bround(gap, 0)))
    return one.join(two, ["y2", "x2"]).select("y", "x", F.format_string("#%02X%02X%02X%02X", "r", "g", "b", "a").alias("hex"), *[unit(c) for c in "rgb"], text.alias("diff"))


def _spread(v: str, old: str, new: str) -> Column:
    """(at, weight) of the pixels of a resized line that a pixel counts for."""
    scale = F.col(old) / F.col(new)
    reach = F.greatest(F.lit(1.0), scale)
    low, high = (F.col(v) + 0.5 - reach) / scale - 0.5, (F.col(v) + 0.5 + reach) / scale - 0.5
    at = F.sequence(F.greatest(F.lit(0), F.ceil(low)).cast("bigint"), F.least(F.col(new) - 1, F.floor(high)).cast("bigint"))
    return F.transform(at, lambda k: F.struct(k.alias("at"), (1 - F.abs(F.col(v) - ((k + 0.5) * scale - 0.5)) / reach).alias("weight")))


def resized(px: DataFrame, width: Column, height: Column) -> DataFrame:
    """Rasters of other sizes, columns of their own ``w`` and ``h``, by a triangle filter that widens as they shrink."""
    size = px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    size = size.withColumns({"nw": width.cast("bigint"), "nh": height.cast("bigint")})
    parts = px.join(size, "img").withColumn("ky", F.explode(_spread("y", "h", "nh"))).withColumn("kx", F.explode(_spread("x", "w", "nw")))
    parts = parts.withColumn("k", F.col("ky.weight") * F.col("kx.weight")).where("k > 0")
    total = F.sum("k")
    mean = lambda c: F.round(F.round(F.sum(F.col(c) * F.col("k")) / total, 6)).cast("bigint").alias(c)
    return parts.groupBy("img", F.col("ky.at").alias("y"), F.col("kx.at").alias("x")).agg(*[mean(c) for c in "rgba"])


def with_aspect(px: DataFrame, ratio: float) -> DataFrame:
    """Rasters stretched to ``ratio`` times their width; within a hundredth of 1 they stay."""
    if abs(ratio - 1) < 1e-2:
        return px
    return resized(px, F.floor(F.greatest(F.lit(1.0), F.col("w") * ratio)), F.col("h"))


def dhash_of(px: DataFrame, columns: int = 9, rows: int = 8) -> DataFrame:
    """64-bit difference hashes of rasters, each reduced as a whole to ``columns`` x ``rows`` pixels."""
    gray = resized(px, F.lit(columns), F.lit(rows)).select("img", "y", "x", F.round(luma()).cast("bigint").alias("v"))
    beside = F.lead("v").over(Window.partitionBy("img", "y").orderBy("x"))
    bits = gray.withColumn("beside", beside).where("beside is not null")
    bit = F.when(F.col("v") > F.col("beside"), F.expr(f"shiftleft(1L, CAST(y * {columns - 1} + x AS INT))")).otherwise(F.lit(0))
    return bits.groupBy("img").agg(F.sum(bit).cast("bigint").alias("h"))


def viewport(px: DataFrame, channels: str, frame: int, columns: int, rows: int, brightness: float, contrast: float, gamma: float, ratio: float = 1.0) -> DataFrame:
    """Channel preview, sprite cell, colour correction and aspect, one after the other."""
    return (
        px.transform(channel_preview, channels).transform(sprite, columns, rows, frame).transform(correct_colors, brightness, contrast, gamma)
        .transform(with_aspect, ratio)
    )


def viewport_compare(px: DataFrame, first: int, second: int, **chain) -> tuple[DataFrame, DataFrame]:
    """The heat of the difference of two rasters after the chain of ``viewport``, and their histograms."""
    seen = viewport(px.where(F.col("img").isin(first, second)), **chain)
    return difference_heat(seen, first, second), luma_histogram(seen)
