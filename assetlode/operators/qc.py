"""Technical quality rules: metadata rules as columns, pixel rules as aggregates over exploded rasters.

Every rule yields (issue, details) rows. Metadata rules cost one pass over the
catalog; all pixel rules of one raster come from grouped aggregates, so a raster
is never brought to one task as a whole by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlode.functions.predicates import DATA_TAGS, has_tag, is_npot
from assetlode.functions.scalars import file_name, stem


def issue(condition: Column, name: Column | str, details: Column | str = "") -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(condition, F.struct(text(name).alias("issue"), text(details).alias("details")))


def melt(df: DataFrame, rules: list[Column], *keys: str) -> DataFrame:
    """One row for each rule that fires; its place in ``rules`` is the order of emission."""
    found = F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull()))
    return df.select(*keys, found.alias("r")).select(*keys, "r.issue", "r.details")


# Metadata rules


def absolute_rules(npot: bool = True, mipmaps: bool = True, block_align: bool = True, bit_depth: bool = True) -> list[Column]:
    w, h, mips, depth = (F.col(c) for c in ("width", "height", "mipmap_count", "bit_depth"))
    return [
        issue(F.lit(npot) & is_npot(w, h), "Non-Power-Of-Two (NPOT)"),
        issue(F.lit(block_align) & ((w % 4 != 0) | (h % 4 != 0)), "Bad Block Alignment (Not divisible by 4)"),
        issue(F.lit(mipmaps) & (F.least(w, h) >= 64) & (mips <= 1), "Missing Mipmaps"),
        issue(F.lit(bit_depth) & (depth > 8), F.format_string("High Bit Depth (%d-bit)", depth)),
    ]


def color_space_rule(tags: list[str] | None = None) -> Column:
    """A data map, by its path, that is encoded as sRGB."""
    wrong = has_tag(F.col("path"), tags or DATA_TAGS) & (F.lower("color_space") == "srgb")
    return issue(wrong, "Color Space Misconfiguration", "Data map texture matches specified data tags but is encoded as sRGB. Data textures must use Linear color space.")


def oversize_rule(limit: int = 4096) -> Column:
    w, h = F.col("width"), F.col("height")
    over = F.lit(limit > 0) & ((w > limit) | (h > limit))
    return issue(over, f"Oversized Texture (>{limit}px)", F.format_string(f"Texture resolution %dx%d exceeds configured project limit of {limit}px.", w, h))


def relative_rules() -> list[Column]:
    """Of columns a_* and b_*: what got worse from A to B."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    note = F.format_string("Compared to Folder A version (%s)", file_name(a("path")))
    return [
        issue(b("width") * b("height") < a("width") * a("height"), "Resolution Downgrade", note),
        issue(b("file_size") > F.floor(a("file_size") * 1.5), "Size Bloat (>1.5x File Size)", note),
        issue(a("has_alpha") & ~b("has_alpha"), "Lost Alpha Channel", note),
        issue(a("color_space") != b("color_space"), F.format_string("Color Space Mismatch (%s -> %s)", a("color_space"), b("color_space")), note),
        issue(F.upper(a("compression_format")) != F.upper(b("compression_format")),
              F.format_string("Format Transition (%s -> %s)", a("compression_format"), b("compression_format")), note),
    ]


def audit(assets: DataFrame, limit: int = 4096, tags: list[str] | None = None, compat_swapped_flags: bool = False, mipmaps: bool = True, block_align: bool = True, npot: bool = True, bit_depth: bool = True) -> DataFrame:
    """All metadata rules, in order of emission: path, issue, details."""
    if compat_swapped_flags:
        mipmaps, block_align = block_align, mipmaps
    return melt(assets, [*absolute_rules(npot, mipmaps, block_align, bit_depth), color_space_rule(tags), oversize_rule(limit)], "path")


def compare_folders(folder_a: DataFrame, folder_b: DataFrame, by_stem: bool = True) -> DataFrame:
    """What got worse in B against the file of the same name in A, of which the last path counts."""
    key = F.lower(stem(file_name(F.col("path"))) if by_stem else file_name(F.col("path")))
    prefixed = lambda df, p: df.select(key.alias("key"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("a_path"))) == 1
    newest = prefixed(folder_a, "a").withColumn("last", last).where("last").drop("last")
    return melt(prefixed(folder_b, "b").join(newest, "key"), relative_rules(), "b_path").withColumnRenamed("b_path", "path")


# Pixel rules, over (img, y, x, r, g, b, a)


def _sides(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _edge_delta(px: DataFrame, size: DataFrame, along: str, across: str, side: str, name: str) -> DataFrame:
    """Mean colour distance between the first and the last line of each raster."""
    first = px.where(F.col(across) == 0).select("img", along, *[F.col(c).alias(f"{c}0") for c in "rgb"])
    last = px.join(size, "img").where(F.col(across) == F.col(side) - 1).select("img", along, "r", "g", "b")
    distance = F.floor((F.abs(F.col("r") - F.col("r0")) + F.abs(F.col("g") - F.col("g0")) + F.abs(F.col("b") - F.col("b0"))) / 3)
    return first.join(last, ["img", along]).groupBy("img").agg(F.avg(distance).alias(name))


def tiling(px: DataFrame, limit: float = 35.0) -> DataFrame:
    size = _sides(px).where("w >= 16 and h >= 16")
    both = _edge_delta(px, size, "y", "x", "w", "across").join(_edge_delta(px, size, "x", "y", "h", "down"), "img")
    text = F.format_string("Opposing edges mismatch (Horizontal Seam Delta: %.1f, Vertical Seam Delta: %.1f)", F.bround("across", 1), F.bround("down", 1))
    return melt(both, [issue((F.col("across") > limit) | (F.col("down") > limit), "Non-Seamless Tiling (Edge Seam)", text)], "img")


def solid(px: DataFrame, slack: int = 2) -> DataFrame:
    """Every pixel within ``slack`` of the first one, on all channels."""
    first = px.where("x = 0 and y = 0").select("img", *[F.col(c).alias(f"{c}0") for c in "rgba"])
    far = [F.max(F.abs(F.col(c) - F.col(f"{c}0"))).alias(f"{c}d") for c in "rgba"]
    seen = px.join(first, "img").groupBy("img", "r0", "g0", "b0", "a0").agg(*far)
    same = (F.greatest("rd", "gd", "bd", "ad") <= slack)
    return melt(seen, [issue(same, "Solid Color Texture", F.format_string("Image is entirely a single color: R:%d, G:%d, B:%d, A:%d", "r0", "g0", "b0", "a0"))], "img")


# What the channels hold.
CHANNEL_NAMES = {"r": "Red (AO/Smoothness)", "g": "Green (Roughness)", "b": "Blue (Metalness)", "a": "Alpha (Glossiness)"}


def empty_channel(px: DataFrame, least_range: int = 5) -> DataFrame:
    """The first channel whose values lie closer together than ``least_range``."""
    ranges = px.groupBy("img").agg(*[f(c).alias(f"{c}_{n}") for c in "rgba" for f, n in ((F.min, "min"), (F.max, "max"))])
    rules = [
        issue(F.col(f"{c}_max") - F.col(f"{c}_min") < least_range, "Empty Channel (Flat Mask)",
              F.format_string(f"Channel {name} is empty/solid color (Min: %d, Max: %d). Check your packing exports.", f"{c}_min", f"{c}_max"))
        for c, name in CHANNEL_NAMES.items()
    ]
    return melt(ranges, [F.coalesce(*rules)], "img")


def alpha_bleed(px: DataFrame, clear: int = 10, opaque: int = 200, least_edges: int = 10, limit: float = 0.40) -> DataFrame:
    """Transparent inner pixels beside opaque ones that are left black."""
    size = _sides(px)
    inner = px.join(size, "img").where((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1) & (F.col("a") < clear))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    around = px.where(F.col("a") > opaque).select("img", F.explode(steps).alias("s"), "x", "y").select("img", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    edges = inner.join(around, ["img", "x", "y"], "left_semi")
    black = F.sum(((F.col("r") < 5) & (F.col("g") < 5) & (F.col("b") < 5)).cast("int")) / F.count(F.lit(1))
    seen = edges.groupBy("img").agg(F.count(F.lit(1)).alias("edges"), black.alias("ratio"))
    text = F.concat(F.format_string("%.0f", F.bround(F.col("ratio") * 100, 0)), F.lit("% of transparent boundary pixels are unpadded black RGB(0,0,0). Will cause dark outline artifacts when mipmapped in game engines."))
    return melt(seen, [issue((F.col("edges") >= least_edges) & (F.col("ratio") > limit), "Missing Alpha Bleed (Edge Padding)", text)], "img")


# What is said about the direction of the green channel.
OPENGL_WRONG = ("Wrong Normal Map Style (OpenGL)", "Texture uses OpenGL (+Y Green) layout. Expected DirectX (-Y Green) for your project pipeline.")
DIRECTX_WRONG = ("Wrong Normal Map Style (DirectX)", "Texture uses DirectX (-Y Green) layout. Expected OpenGL (+Y Green) for your project pipeline.")
OPENGL_SEEN = ("Normal Map Orientation", "OpenGL layout detected (+Y Green channel).")
DIRECTX_SEEN = ("Normal Map Orientation", "DirectX layout detected (-Y Green channel).")


def normal_orientation(px: DataFrame, target: str = "any") -> DataFrame:
    """Which way green points, from its vertical steps; ``target`` is directx, opengl or any."""
    column = Window.partitionBy("img", "x").orderBy("y")
    near = px.select("img", "x", "y", "g", F.lag("g").over(column).alias("up"), F.lead("g").over(column).alias("down"))
    size = _sides(px).where("w >= 4 and h >= 4")
    steep = near.join(size, "img").where((F.col("x") > 0) & (F.col("x") < F.col("w") - 1) & (F.abs(F.col("down") - F.col("up")) > 30))
    lit = F.sum((F.col("g") > 128).cast("int"))
    seen = steep.groupBy("img").agg(lit.alias("top"), F.count(F.lit(1)).alias("all")).where("top > 0 and top < all")
    gl, dx = F.col("top") / F.col("all") > 0.60, F.col("top") / F.col("all") < 0.40
    rules = {"directx": [issue(gl, *OPENGL_WRONG)], "opengl": [issue(dx, *DIRECTX_WRONG)], "any": [issue(gl, *OPENGL_SEEN), issue(dx, *DIRECTX_SEEN)]}
    return melt(seen, rules[target], "img")


def normal_integrity(px: DataFrame, slack: float = 0.15, bc5: bool = False) -> DataFrame:
    """Lengths of the vectors that the colours stand for."""
    x, y, z = (F.col(c) / F.lit(255.0) * 2 - 1 for c in "rgb")
    share = lambda bad: F.avg(bad.cast("double"))
    seen = px.groupBy("img").agg(
        F.avg(z).alias("z"), share(F.sqrt(x * x + y * y) - 1 > slack).alias("clip"),
        share(F.abs(F.sqrt(x * x + y * y + z * z) - 1) > slack).alias("off"), share(x * x + y * y > 1 + slack).alias("over"))
    part = lambda c, text: F.concat(F.format_string("%.0f", F.bround(F.col(c) * 100, 0)), F.lit(text))
    if bc5:
        return melt(seen, [issue(F.col("over") > 0.10, "Bad BC5 Normal Map", part("over", "% of pixels exceed reconstruction limits (X^2 + Y^2 > 1.0)"))], "img")
    up, off = F.col("z") > 0.98, F.col("off") > 0.10
    return melt(seen, [
        issue(up & (F.col("clip") > 0.10), "Bad Normal Map (XY Clip)", part("clip", "% of pixels exceed tangent unit circle bounds")),
        issue(~up & off, "Bad Normal Map (Integrity)", part("off", "% of pixels have invalid vector lengths")),
        issue(~up & ~off & (F.col("z") < 0.2), "Inverted Z / Not Tangent Space", "Z-Axis represents flat or inverted normals"),
    ], "img")
