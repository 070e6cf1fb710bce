"""Technical metadata from the first bytes of image files, by their public formats.

``probe(name, data)`` never raises: what cannot be read gives the fallback row,
with the reason in ``error``.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from dataclasses import asdict, dataclass, replace

from assetlode.functions.scalars import DXGI_NAMES, LOADERS

MOST_PIXELS = 16_384


@dataclass
class Metadata:
    width: int = 0
    height: int = 0
    file_size: int = 0
    format_str: str = ""
    compression_format: str = ""
    color_space: str = "sRGB"
    has_alpha: bool = False
    bit_depth: int = 8
    mipmap_count: int = 1
    is_cubemap: bool = False
    error: str | None = None


SCHEMA = ("width int, height int, file_size bigint, format_str string, compression_format string, color_space string, "
          "has_alpha boolean, bit_depth int, mipmap_count int, is_cubemap boolean, error string")

Parser = "callable[[str, bytes], Metadata]"


def _u(fmt: str, data: bytes, at: int) -> int:
    return struct.unpack_from(fmt, data, at)[0]


def _need(condition: bool, what: str) -> None:
    if not condition:
        raise ValueError(what)


def dds(ext: str, d: bytes) -> Metadata:
    _need(d[:4] == b"DDS " and _u("<I", d, 4) == 124, "no DDS header")
    h, w, mips = _u("<I", d, 12), _u("<I", d, 16), max(1, _u("<I", d, 28))
    _need(0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS, "dimensions out of range")
    flags, code, bits = _u("<I", d, 80), d[84:88].decode("latin1").strip("\0 "), _u("<I", d, 88)
    m = Metadata(w, h, mipmap_count=mips, is_cubemap=bool(_u("<I", d, 112) & 0xFE00), has_alpha=bool(flags & 3), color_space="sRGB")
    if code == "DX10":
        dxgi = _u("<I", d, 128)
        return replace(m, compression_format=DXGI_NAMES.get(dxgi, f"DX10 (DXGI {dxgi})"), has_alpha=dxgi in (74, 75, 77, 78, 98, 99), color_space="Linear" if dxgi in (71, 74, 77, 80, 83, 98) else "sRGB")
    if flags & 4 and code:
        return replace(m, compression_format=code, has_alpha=m.has_alpha or code in ("DXT3", "DXT5"))
    return replace(m, compression_format="Uncompressed", bit_depth=bits // 4 or 8)


# Names of KTX2 supercompression schemes.
SCHEMES = {1: "BasisLZ", 2: "Zstandard", 3: "ZLIB"}


def ktx2(ext: str, d: bytes) -> Metadata:
    _need(d[:12] == b"\xabKTX 20\xbb\r\n\x1a\n", "no KTX2 identifier")
    vk, _, w, h, _, _, faces, levels, scheme = struct.unpack_from("<9I", d, 12)
    dfd = _u("<I", d, 48)
    transfer = d[dfd + 14] if 0 < dfd < len(d) - 15 else 2
    return Metadata(max(1, w), max(1, h), compression_format=f"KTX2 ({SCHEMES.get(scheme) or f'VkFormat {vk}'})", color_space="sRGB" if transfer == 2 else "Linear", has_alpha=True, mipmap_count=max(1, levels), is_cubemap=faces == 6)


def astc(ext: str, d: bytes) -> Metadata:
    _need(d[:4] == b"\x13\xab\xa1\x5c" or d[:4] == b"\x5c\xa0\x39\x5c", "no ASTC magic")
    w, h = (int.from_bytes(d[k : k + 3], "little") for k in (7, 10))
    return Metadata(w, h, compression_format=f"ASTC {d[4]}x{d[5]}", has_alpha=True)


def atc_dims(n: int) -> tuple[int, int]:
    """A headerless payload's dimensions, from its length."""
    for total, pixels in ((n, n), (n, 2 * n)):
        side = int(pixels**0.5)
        if side and side % 4 == 0 and side * side == pixels:
            return side, side
    for pixels in (n, 2 * n):
        side = int((pixels // 2) ** 0.5)
        if side and side % 4 == 0 and 2 * side * side == pixels:
            return 2 * side, side
    return 0, 0


def atc(ext: str, d: bytes, size: int = 0) -> Metadata:
    m = Metadata(compression_format="Qualcomm ATC", color_space="Linear", has_alpha=True)
    if len(d) >= 16 and d[:4] == b"ATC ":
        w, h = struct.unpack_from("<II", d, 4)
        if 0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS:
            return replace(m, width=w, height=h)
    w, h = atc_dims(size or len(d))
    return replace(m, width=w, height=h)


def pvr(ext: str, d: bytes) -> Metadata:
    if len(d) >= 52 and _u("<I", d, 0) == 0x03525650:
        return Metadata(_u("<I", d, 28), _u("<I", d, 24), compression_format="PVR v3", has_alpha=True, mipmap_count=max(1, _u("<I", d, 44)))
    _need(len(d) >= 52 and d[44:48] in (b"PVR!", b"PVRT"), "no PVR header")
    # The public layout has the header's size first; archives tagged PVRT begin with the height.
    at = 4 if d[44:48] == b"PVR!" else 0
    return Metadata(_u("<I", d, at + 4), _u("<I", d, at), compression_format="PVR v2", has_alpha=True)


def crn(ext: str, d: bytes) -> Metadata:
    _need(d[:2] == b"Hx" and len(d) >= 18, "no CRN header")
    w, h = struct.unpack_from(">HH", d, 12)
    return Metadata(w, h, compression_format="Crunch (CRN)", has_alpha=True, mipmap_count=max(1, d[16]), is_cubemap=d[17] == 6)


# Names of EXR compressions.
EXR_COMPRESSIONS = ["Uncompressed", "RLE", "ZIP1", "ZIP16", "PIZ", "PXR24", "B44", "B44A", "DWAA", "DWAB"]


def exr(ext: str, d: bytes) -> Metadata:
    _need(d[:4] == b"\x76\x2f\x31\x01", "no EXR magic")
    at, found = 8, {}
    while at < len(d) and d[at]:
        name_end = d.index(b"\0", at)
        type_end = d.index(b"\0", name_end + 1)
        n = _u("<I", d, type_end + 1)
        found[d[at:name_end].decode("latin1")] = d[type_end + 5 : type_end + 5 + n]
        at = type_end + 5 + n
    x0, y0, x1, y1 = struct.unpack("<4i", found["displayWindow"])
    channels, at, raw = [], 0, found.get("channels", b"\0")
    while at < len(raw) and raw[at]:
        end = raw.index(b"\0", at)
        channels.append(raw[at:end].decode("latin1"))
        at = end + 17
    code = found.get("compression", b"\0")[0]
    return Metadata(x1 - x0 + 1, y1 - y0 + 1, compression_format=f"EXR ({EXR_COMPRESSIONS[code] if code < len(EXR_COMPRESSIONS) else code})", color_space="Linear", bit_depth=16, has_alpha=any(c in ("A", "alpha") for c in channels))


# PSD colour modes.
PSD_MODES = {0: "Bitmap", 1: "Grayscale", 2: "Indexed", 3: "RGB", 4: "CMYK", 7: "Multichannel", 8: "Duotone", 9: "Lab"}


def psd(ext: str, d: bytes) -> Metadata:
    _need(d[:4] == b"8BPS" and len(d) >= 26, "no PSD header")
    h, w, depth, mode = struct.unpack_from(">IIHH", d, 14)
    return Metadata(w, h, compression_format="PSD", color_space=PSD_MODES.get(mode, "Unknown"), has_alpha=True, bit_depth=depth if depth in (1, 8, 16, 32) else 8)


def _boxes(d: bytes, at: int, end: int):
    while at + 8 <= end:
        n, kind = _u(">I", d, at), d[at + 4 : at + 8]
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = _u(">Q", d, at + 8), 16
        n = n or end - at
        yield kind, at + head, min(end, at + n)
        if n < head:
            return
        at += n


# Colour primaries of CICP.
PRIMARIES = {1: "sRGB (BT.709)", 9: "BT.2020", 12: "Display P3"}


def heif(ext: str, d: bytes) -> Metadata:
    d = d[: 64 << 10]
    _need(d[4:8] == b"ftyp", "no ftyp box")
    m = Metadata(compression_format=ext.upper(), has_alpha=False)
    stack = [(0, len(d))]
    while stack:
        a, z = stack.pop()
        for kind, start, end in _boxes(d, a, z):
            if kind == b"meta":
                stack.append((start + 4, end))
            elif kind in (b"iprp", b"ipco"):
                stack.append((start, end))
            elif kind == b"ispe" and end - start >= 12:
                w, h = struct.unpack_from(">II", d, start + 4)
                if w * h > m.width * m.height:
                    m = replace(m, width=w, height=h)
            elif kind == b"colr" and d[start : start + 4] == b"nclx":
                m = replace(m, color_space=PRIMARIES.get(_u(">H", d, start + 4), "sRGB"))
            elif kind == b"pixi" and end - start >= 6:
                m = replace(m, bit_depth=d[start + 5])
            elif kind == b"auxC" and b"alpha" in d[start:end]:
                m = replace(m, has_alpha=True)
    return m


def jxl(ext: str, d: bytes) -> Metadata:
    if d[4:8] == b"JXL ":
        d = next((d[a:z] for kind, a, z in _boxes(d, 0, len(d)) if kind in (b"jxlc", b"jxlp")), b"")
        d = d if d[:2] == b"\xff\x0a" else d[4:]
    _need(d[:2] == b"\xff\x0a", "no JPEG XL codestream")
    bits, at = int.from_bytes(d[2:18], "little"), 0

    def take(n: int) -> int:
        nonlocal at
        out = bits >> at & ((1 << n) - 1)
        at += n
        return out

    def size() -> int:
        return take((9, 13, 18, 30)[take(2)]) + 1

    small = take(1)
    h = 8 * (take(5) + 1) if small else size()
    ratio = take(3)
    if ratio:
        a, b = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))[ratio - 1]
        w = h * a // b
    else:
        w = 8 * (take(5) + 1) if small else size()
    return Metadata(w, h, compression_format="JPEG XL", has_alpha=True)


def _tiff_tags(d: bytes, at: int = 0) -> list[dict[int, list[int]]]:
    order = {b"II": "<", b"MM": ">"}[d[at : at + 2]]
    found, queue, seen = [], [_u(order + "I", d, at + 4)], set()
    sizes = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 13: (4, "I")}
    while queue and len(found) < 32:
        ifd = queue.pop(0)
        if not ifd or ifd in seen or at + ifd + 2 > len(d):
            continue
        seen.add(ifd)
        n, tags = _u(order + "H", d, at + ifd), {}
        for k in range(n):
            p = at + ifd + 2 + 12 * k
            if p + 12 > len(d):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", d, p)
            if kind in sizes and count <= 64:
                width, code = sizes[kind]
                where = p + 8 if width * count <= 4 else at + _u(order + "I", d, p + 8)
                if where + width * count <= len(d):
                    tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", d, where))
        queue += tags.get(330, [])
        nxt = at + ifd + 2 + 12 * n
        if nxt + 4 <= len(d):
            queue.append(_u(order + "I", d, nxt))
        found.append(tags)
    return found


def camera_raw(ext: str, d: bytes) -> Metadata:
    m = Metadata(compression_format=f"Camera RAW ({ext.upper()})", color_space="Linear", bit_depth=14)
    if d[4:8] == b"ftyp":
        return replace(heif(ext, d), compression_format=m.compression_format, color_space="Linear", bit_depth=14)
    w, h = max(((t[256][0], t[257][0]) for t in _tiff_tags(d) if 256 in t and 257 in t), key=lambda x: x[0] * x[1], default=(0, 0))
    return replace(m, width=w, height=h)


def qoi(ext: str, d: bytes) -> Metadata:
    _need(d[:4] == b"qoif" and len(d) >= 14, "no QOI header")
    return Metadata(_u(">I", d, 4), _u(">I", d, 8), compression_format="QOI", has_alpha=d[12] == 4, color_space="Linear" if d[13] else "sRGB")


def svg(ext: str, d: bytes) -> Metadata:
    if d[:2] == b"\x1f\x8b":
        d = gzip.decompress(d)
    m = Metadata(512, 512, compression_format="SVG", has_alpha=True)
    root = re.search(rb"<svg\b[^>]*>", d, re.S)
    if not root:
        return replace(m, error="no svg element")
    side = {k.decode(): float(v) for k, v in re.findall(rb"\b(width|height)\s*=\s*[\"']\s*([0-9.]+)(?:px)?\s*[\"']", root[0])}
    box = re.search(rb"viewBox\s*=\s*[\"']\s*([-0-9.eE]+)[\s,]+([-0-9.eE]+)[\s,]+([0-9.eE]+)[\s,]+([0-9.eE]+)", root[0])
    if box:
        side = {"width": float(box[3]), "height": float(box[4])} | side
    return replace(m, width=round(side.get("width", 512)), height=round(side.get("height", 512)))


def _jpeg(d: bytes) -> tuple[int, int, int, int]:
    at = 2
    while at + 9 < len(d):
        if d[at] != 0xFF:
            at += 1
            continue
        mark = d[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return _u(">H", d, at + 7), _u(">H", d, at + 5), d[at + 9], d[at + 4]
        at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8 else 2 + _u(">H", d, at + 2)
    raise ValueError("no JPEG frame")


def standard(ext: str, d: bytes) -> Metadata:
    m = Metadata(compression_format=ext.upper())
    if d[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth, kind = struct.unpack_from(">IIBB", d, 16)
        return replace(m, width=w, height=h, bit_depth=8 if kind == 3 or depth < 8 else depth, has_alpha=kind in (4, 6) or b"tRNS" in d[: max(0, d.find(b"IDAT"))])
    if d[:2] == b"\xff\xd8":
        w, h, _, depth = _jpeg(d)
        return replace(m, width=w, height=h, bit_depth=depth)
    if d[:4] in (b"GIF8",):
        return replace(m, width=_u("<H", d, 6), height=_u("<H", d, 8), has_alpha=True)
    if d[:2] == b"BM":
        bits = _u("<H", d, 28)
        return replace(m, width=abs(_u("<i", d, 18)), height=abs(_u("<i", d, 22)), has_alpha=bits == 32)
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        kind = d[12:16]
        if kind == b"VP8X":
            return replace(m, width=int.from_bytes(d[24:27], "little") + 1, height=int.from_bytes(d[27:30], "little") + 1, has_alpha=bool(d[20] & 16))
        if kind == b"VP8L":
            v = _u("<I", d, 21)
            return replace(m, width=(v & 0x3FFF) + 1, height=(v >> 14 & 0x3FFF) + 1, has_alpha=bool(v >> 28 & 1))
        return replace(m, width=_u("<H", d, 26) & 0x3FFF, height=_u("<H", d, 28) & 0x3FFF)
    if d[:10] in (b"#?RADIANCE",) or d[:6] == b"#?RGBE":
        size = re.search(rb"[-+]Y (\d+) [-+]X (\d+)", d)
        _need(size is not None, "no Radiance resolution")
        return replace(m, width=int(size[2]), height=int(size[1]), compression_format="Radiance HDR", color_space="Linear", bit_depth=32)
    if d[:4] in (b"II*\0", b"MM\0*"):
        tags = _tiff_tags(d)[0]
        return replace(m, width=tags[256][0], height=tags[257][0], bit_depth=tags.get(258, [8])[0], has_alpha=338 in tags)
    if d[:4] == b"\0\0\1\0":
        return replace(m, width=d[6] or 256, height=d[7] or 256, has_alpha=True)
    if d[4:8] == b"ftyp":
        return replace(heif(ext, d), compression_format=ext.upper())
    if ext == "tga" and len(d) >= 18:
        return replace(m, width=_u("<H", d, 12), height=_u("<H", d, 14), has_alpha=d[16] == 32 or d[17] & 15 > 0)
    raise ValueError("unknown image format")


def uasset(ext: str, d: bytes) -> Metadata:
    """A packaged texture: the largest PNG or JPEG inside gives the size; a normal map by its format name is linear."""
    _need(b"Texture" in d, "not a texture package")
    best = Metadata(compression_format="UASSET")
    for sign in (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"):
        at = d.find(sign)
        while at >= 0:
            try:
                found = standard("png" if sign[0] == 0x89 else "jpg", d[at:])
                if found.width * found.height > best.width * best.height:
                    best = replace(best, width=found.width, height=found.height, has_alpha=found.has_alpha, bit_depth=found.bit_depth)
            except (ValueError, struct.error, IndexError):
                pass
            at = d.find(sign, at + 1)
    return replace(best, color_space="Linear" if b"BC5" in d or b"NORMAL" in d.upper() else "sRGB")


PARSERS = {"uasset": uasset, "dds": dds, "exr": exr, "psd": psd, "jxl": jxl, "heic": heif, "ktx2": ktx2, "raw": camera_raw, "astc": astc, "pvr": pvr, "qoi": qoi, "svg": svg, "atc": atc, "crn": crn, "standard": standard}
BY_EXTENSION = {e: PARSERS[loader] for loader, extensions in LOADERS.items() for e in extensions}


def extension_of(path: str) -> str:
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def probe(path: str, data: bytes, size: int | None = None) -> dict:
    """The metadata row of a file."""
    ext = extension_of(path)
    size = len(data) if size is None else size
    base = Metadata(file_size=size, format_str=ext, compression_format=ext)
    parser = BY_EXTENSION.get(ext)
    if parser is None:
        return asdict(replace(base, error="no loader for this extension"))
    try:
        found = parser(ext, data, size) if parser is atc else parser(ext, data)
    except (ValueError, struct.error, IndexError, KeyError, zlib.error, OSError, EOFError) as e:
        return asdict(replace(base, error=f"{type(e).__name__}: {e}"))
    return asdict(replace(found, file_size=size, format_str=ext))
