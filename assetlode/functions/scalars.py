"""Column functions over catalog rows; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]

# Names of DXGI formats.
DXGI_NAMES = {
    2: "RGBA32 Float", 10: "RGBA16 Float", 11: "RGBA16 UNORM", 24: "RGB10A2 UNORM", 28: "RGBA8 UNORM", 29: "RGBA8 sRGB",
    54: "R16 Float", 56: "R16 UNORM", 61: "R8 UNORM", 70: "BC1 (DXT1)", 71: "BC1 (DXT1)", 72: "BC1 sRGB (DXT1)",
    73: "BC2 (DXT3)", 74: "BC2 (DXT3)", 75: "BC2 sRGB (DXT3)", 76: "BC3 (DXT5)", 77: "BC3 (DXT5)", 78: "BC3 sRGB (DXT5)",
    79: "BC4 (ATI1)", 80: "BC4 (ATI1)", 81: "BC4 SNORM", 82: "BC5 (ATI2)", 83: "BC5 (ATI2)", 84: "BC5 SNORM",
    87: "BGRA8 UNORM", 91: "BGRA8 sRGB", 94: "BC6H (UF16)", 95: "BC6H (UF16)", 96: "BC6H (SF16)", 97: "BC7", 98: "BC7", 99: "BC7 sRGB",
}

# File extensions by the loader that reads them, in the order in which loaders are asked.
LOADERS = {
    "uasset": ["uasset"], "dds": ["dds"], "exr": ["exr"], "psd": ["psd"], "jxl": ["jxl"], "heic": ["heic", "heif"],
    "ktx2": ["ktx2", "basis"], "raw": ["cr2", "nef", "arw", "dng", "cr3"], "astc": ["astc"], "pvr": ["pvr"], "qoi": ["qoi"],
    "svg": ["svg", "svgz"], "atc": ["atc"], "crn": ["crn"],
    "standard": ["png", "jpg", "jpeg", "tga", "bmp", "hdr", "tif", "tiff", "webp", "gif", "avif", "ico"],
}


# Text


def format_size(size: Column) -> Column:
    """``0 B``, ``1.50 KB`` and so on, ties to even."""
    out = F.when(size == 0, F.lit("0 B"))
    for k in range(len(UNITS) - 1, -1, -1):
        value = F.bround(size.cast("double") / F.lit(float(1024**k)), 2)
        out = out.when(size >= F.lit(1024**k), F.format_string(f"%.2f {UNITS[k]}", value))
    return out


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(value, digits))


def similarity_label(similarity: Column, is_best: Column) -> Column:
    return F.when(is_best, F.lit("[Best]")).when(similarity > 0, percent(similarity)).otherwise(F.lit("-"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its extension; a name that only begins with a dot has none."""
    return F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def normalize_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def decode_uri(uri: Column) -> Column:
    """Percent-decoding that leaves plus signs alone, and no scheme in front of a local path."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def elide(text: Column, most: int = 40, side: int = 18) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(side)), F.lit("..."), F.right(text, F.lit(side)))).otherwise(text)


def parse_dims(text: Column) -> tuple[Column, Column]:
    """Width and height from ``WxH``; null unless both are in 1 to 16384."""
    pattern = r"^[\t ]*\+?([0-9]+)[\t ]*[xX*][\t ]*\+?([0-9]+)[\t ]*$"
    w, h = (F.regexp_extract(text, pattern, k).try_cast("bigint") for k in (1, 2))
    fits = w.between(1, 16384) & h.between(1, 16384)
    return F.when(fits, w), F.when(fits, h)


# Formats


def loader_of(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, extensions in reversed(LOADERS.items()):
        out = F.when(F.lower(ext).isin(extensions), F.lit(name)).otherwise(out)
    return out


def dxgi_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DXGI_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.format_string("DX10 (DXGI %d)", code))


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _blocks(n: Column, size: int) -> Column:
    return F.floor((n + (size - 1)) / size).cast("bigint")


SMALL_BLOCKS = ["BC1", "DXT1", "BC4", "ATI1"]
LARGE_BLOCKS = ["BC2", "DXT3", "BC3", "DXT5", "BC5", "ATI2", "BC6", "BC7"]


def estimate_vram(width: Column, height: Column, compression: Column, mips: Column, cubemap: Column) -> Column:
    """Bytes of a texture in video memory: each mip's rows padded to 256 bytes, six faces of a cube."""
    name = F.upper(compression)
    packed = _any(name, ["BC", "DXT", "ATI"])
    per_block = F.when(_any(name, SMALL_BLOCKS), 8).when(_any(name, LARGE_BLOCKS), 16).otherwise(0)
    four = _any(name, ["RGBA8", "BGRA8"]) | (name.contains("UNCOMPRESSED") & name.contains("ALPHA"))
    per_pixel = F.when(four, 4).when(_any(name, ["RGB8", "BGR8", "UNCOMPRESSED"]), 3).when(name.contains("RGBA16"), 8).when(name.contains("RGBA32"), 16).otherwise(4)
    unit, edge = F.when(packed, per_block).otherwise(per_pixel).cast("bigint"), F.when(packed, 4).otherwise(1)

    def level(i: Column) -> Column:
        shifted = [F.when(i > 31, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(side / F.pow(F.lit(2.0), i)))).cast("bigint") for side in (width, height)]
        columns, rows = (F.floor((s + edge - 1) / edge).cast("bigint") for s in shifted)
        return F.floor((columns * unit + 255) / 256).cast("bigint") * 256 * rows

    levels = F.sequence(F.lit(0), F.greatest(mips, F.lit(1)).cast("int") - 1)
    total = F.aggregate(levels, F.lit(0).cast("bigint"), lambda acc, i: acc + level(i))
    return total * F.when(cubemap, 6).otherwise(1)


def payload_bytes(width: Column, height: Column, name: Column) -> Column:
    """Bytes of an uncompressed or block-compressed payload; 0 if out of range or above 256 MiB."""
    name = F.upper(name)
    blocks = _blocks(width, 4) * _blocks(height, 4)
    total = (
        F.when(_any(name, [*SMALL_BLOCKS, "TC_DEFAULT"]), blocks * 8)
        .when(_any(name, [*LARGE_BLOCKS, "ASTC", "TC_NORMALMAP", "TC_MASKS", "TC_GRAYSCALE"]), blocks * 16)
        .otherwise(width * height * 4)
    )
    fits = width.between(1, 16384) & height.between(1, 16384) & (total <= 256 * 1024 * 1024)
    return F.when(fits, total).otherwise(F.lit(0)).cast("bigint")


def atc_dims(length: Column) -> Column:
    """A headerless payload's width and height from its length: a square or two to one, at 1 or 1/2 byte a pixel."""

    def side(n: Column, wide: int, pixels: int) -> Column:
        s = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
        return F.when((s > 0) & (s % 4 == 0) & (s * s * wide == length * pixels), F.struct((s * wide).alias("width"), s.alias("height")))

    return F.coalesce(side(length, 1, 1), side(length * 2, 1, 2), side(F.floor(length / 2), 2, 1), side(length, 2, 2))


# Byte sizes of one slice by VkFormat; block shapes of ASTC.
PIXEL_BYTES = {4: [37, 43, 44, 50, 122, 123], 3: [23, 29, 30, 36], 1: [9, 15], 2: [16, 22], 8: [97], 16: [109]}
BLOCKS_8 = [131, 132, 133, 134, 139, 140, 147, 148, 149, 150, 153, 154, 1000054001, 1000054003, 1000054005, 1000054007]
BLOCKS_16 = [135, 136, 137, 138, 141, 142, 143, 144, 145, 146, 151, 152, 155, 156]
BLOCKS_WIDE = [1000054000, 1000054002, 1000054004, 1000054006]
ASTC_SHAPES = [(4, 4), (5, 4), (5, 5), (6, 5), (6, 6), (8, 5), (8, 6), (8, 8), (10, 5), (10, 6), (10, 8), (10, 10), (12, 10), (12, 12)]


def slice_bytes(vk_format: Column, width: Column, height: Column) -> Column:
    """Bytes of one face of one layer at level 0; null for formats without a known size.

    Code 160 is ASTC 5x4 in sRGB, and counted so.
    """
    out = F.lit(None).cast("bigint")
    for size, codes in PIXEL_BYTES.items():
        out = F.when(vk_format.isin(codes), width * height * size).otherwise(out)
    out = F.when(vk_format.isin(BLOCKS_8), _blocks(width, 4) * _blocks(height, 4) * 8).otherwise(out)
    out = F.when(vk_format.isin(BLOCKS_16), _blocks(width, 4) * _blocks(height, 4) * 16).otherwise(out)
    out = F.when(vk_format.isin(BLOCKS_WIDE), _blocks(width, 8) * _blocks(height, 4) * 8).otherwise(out)
    for k, (bx, by) in enumerate(ASTC_SHAPES):
        out = F.when(vk_format.isin(157 + 2 * k, 158 + 2 * k, 1000066000 + k), _blocks(width, bx) * _blocks(height, by) * 16).otherwise(out)
    return out


def mip_for_target(width: Column, height: Column, mips: Column, target: int) -> Column:
    """The last level on which both sides still reach ``target``, or 0."""
    levels = F.sequence(F.lit(0), F.greatest(mips, F.lit(1)).cast("int") - 1)
    reach = F.filter(levels, lambda i: (F.floor(width / F.pow(F.lit(2.0), i)) >= target) & (F.floor(height / F.pow(F.lit(2.0), i)) >= target))
    return F.coalesce(F.array_max(reach), F.lit(0)).cast("bigint")


# Hashes


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(distance: Column, bits: int = 64) -> Column:
    return (1 - distance / bits) * 100


def max_distance(similarity: float, bits: int = 64) -> int:
    """The largest Hamming distance that a similarity in percent allows; halves round up."""
    return int((100 - similarity) / 100 * bits + 0.5)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a vector that is almost zero stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 1e-12, x.cast("double") / norm).otherwise(x.cast("double")))
