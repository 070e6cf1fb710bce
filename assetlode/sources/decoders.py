"""Pixels from bytes for the formats that need no foreign codec, by their public descriptions.

Rasters are (height, width, 4) arrays of uint8. Formats without a codec here give
None: their metadata is still read.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np

from assetlode.sources.headers import MOST_PIXELS, extension_of


def inflate(data: bytes, scheme: str) -> bytes:
    """zstd, zlib or gzip streams."""
    if scheme == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {"zlib": zlib.decompress, "gzip": gzip.decompress}[scheme](data)


def qoi(data: bytes) -> np.ndarray:
    if data[:4] != b"qoif":
        raise ValueError("no QOI header")
    w, h = struct.unpack_from(">II", data, 4)
    if not (0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS):
        raise ValueError("dimensions out of range")
    out = bytearray()
    seen = [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    at, want = 14, w * h * 4
    while len(out) < want:
        op = data[at]
        at += 1
        run = 1
        if op == 0xFE:
            r, g, b = data[at : at + 3]
            at += 3
        elif op == 0xFF:
            r, g, b, a = data[at : at + 4]
            at += 4
        elif op < 0x40:
            r, g, b, a = seen[op]
        elif op < 0x80:
            r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
        elif op < 0xC0:
            dg, rest = (op & 63) - 32, data[at]
            at += 1
            r, g, b = (r + dg + (rest >> 4) - 8) & 255, (g + dg) & 255, (b + dg + (rest & 15) - 8) & 255
        else:
            run = (op & 63) + 1
        seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = (r, g, b, a)
        out += bytes((r, g, b, a)) * run
    return np.frombuffer(bytes(out[:want]), dtype=np.uint8).reshape(h, w, 4)


def _blocks(data: bytes, w: int, h: int, size: int) -> tuple[np.ndarray, int, int]:
    bw, bh = -(-w // 4), -(-h // 4)
    raw = np.frombuffer(data, dtype=np.uint8, count=bw * bh * size).reshape(bh * bw, size)
    return raw, bw, bh


def _image(texels: np.ndarray, bw: int, bh: int, w: int, h: int) -> np.ndarray:
    """(blocks, 16, channels) as a picture."""
    c = texels.shape[2]
    return texels.reshape(bh, bw, 4, 4, c).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, c)[:h, :w]


def _565(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int32)
    r, g, b = v >> 11, v >> 5 & 63, v & 31
    return np.stack([(r << 3) | (r >> 2), (g << 2) | (g >> 4), (b << 3) | (b >> 2)], axis=1)


def _colors(raw: np.ndarray, always_four: bool) -> np.ndarray:
    """Colour blocks of eight bytes: (blocks, 16, 4)."""
    ends = raw[:, :4].copy().view("<u2")
    bits = raw[:, 4:8].copy().view("<u4")[:, 0]
    a, b = _565(ends[:, 0]), _565(ends[:, 1])
    four = (ends[:, 0] > ends[:, 1])[:, None] | always_four
    third = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    last = np.where(four, (a + 2 * b) // 3, 0)
    palette = np.concatenate([np.stack([a, b, third, last], axis=1), np.full((len(raw), 4, 1), 255)], axis=2)
    palette[:, 3, 3] = np.where(four[:, 0], 255, 0)
    index = bits[:, None] >> (2 * np.arange(16, dtype=np.uint32)) & 3
    return np.take_along_axis(palette, index[:, :, None].astype(np.int64), axis=1)


def _ramp(raw: np.ndarray) -> np.ndarray:
    """Single-channel blocks of eight bytes: (blocks, 16)."""
    a, b = raw[:, 0].astype(np.int32), raw[:, 1].astype(np.int32)
    six = (a <= b)[:, None]
    k = np.arange(1, 7)
    eight_way = ((7 - k) * a[:, None] + k * b[:, None]) // 7
    k = np.arange(1, 5)
    six_way = np.concatenate([((5 - k) * a[:, None] + k * b[:, None]) // 5, np.tile([0, 255], (len(raw), 1))], axis=1)
    palette = np.concatenate([a[:, None], b[:, None], np.where(six, six_way, eight_way)], axis=1)
    bits = np.zeros(len(raw), dtype=np.uint64)
    for i in range(6):
        bits |= raw[:, 2 + i].astype(np.uint64) << np.uint64(8 * i)
    index = (bits[:, None] >> (np.uint64(3) * np.arange(16, dtype=np.uint64)) & np.uint64(7)).astype(np.int64)
    return np.take_along_axis(palette, index, axis=1)


def bc1(data: bytes, w: int, h: int) -> np.ndarray:
    raw, bw, bh = _blocks(data, w, h, 8)
    return _image(_colors(raw, False), bw, bh, w, h).astype(np.uint8)


def bc2(data: bytes, w: int, h: int) -> np.ndarray:
    raw, bw, bh = _blocks(data, w, h, 16)
    texels = _colors(raw[:, 8:], True)
    nibbles = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], axis=2).reshape(len(raw), 16)
    texels[:, :, 3] = nibbles.astype(np.int64) * 17
    return _image(texels, bw, bh, w, h).astype(np.uint8)


def bc3(data: bytes, w: int, h: int) -> np.ndarray:
    raw, bw, bh = _blocks(data, w, h, 16)
    texels = _colors(raw[:, 8:], True)
    texels[:, :, 3] = _ramp(raw[:, :8])
    return _image(texels, bw, bh, w, h).astype(np.uint8)


def bc4(data: bytes, w: int, h: int) -> np.ndarray:
    raw, bw, bh = _blocks(data, w, h, 8)
    v = _ramp(raw)
    return _image(np.stack([v, v, v, np.full_like(v, 255)], axis=2), bw, bh, w, h).astype(np.uint8)


def bc5(data: bytes, w: int, h: int) -> np.ndarray:
    """Red and green; blue is the third coordinate of the unit normal."""
    raw, bw, bh = _blocks(data, w, h, 16)
    r, g = _ramp(raw[:, :8]), _ramp(raw[:, 8:])
    x, y = r / 127.5 - 1, g / 127.5 - 1
    z = np.sqrt(np.clip(1 - x * x - y * y, 0, 1))
    return _image(np.stack([r, g, np.rint((z + 1) * 127.5), np.full_like(r, 255)], axis=2), bw, bh, w, h).astype(np.uint8)


def bgra(data: bytes, w: int, h: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8, count=w * h * 4).reshape(h, w, 4)[:, :, [2, 1, 0, 3]]


def rgba(data: bytes, w: int, h: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8, count=w * h * 4).reshape(h, w, 4)


def rgb(data: bytes, w: int, h: int) -> np.ndarray:
    return np.dstack([np.frombuffer(data, dtype=np.uint8, count=w * h * 3).reshape(h, w, 3), np.full((h, w), 255, np.uint8)])


def red(data: bytes, w: int, h: int) -> np.ndarray:
    v = np.frombuffer(data, dtype=np.uint8, count=w * h).reshape(h, w)
    return np.dstack([v, v, v, np.full_like(v, 255)])


def _eight(v: np.ndarray) -> np.ndarray:
    """Linear values as bytes: what is outside 0 to 1 is clamped, what is no number is 0."""
    return (np.clip(np.nan_to_num(v.astype(np.float64), nan=0.0, posinf=1.0, neginf=0.0), 0, 1) * 255).astype(np.uint8)


def _opaque(colors: np.ndarray) -> np.ndarray:
    return np.dstack([_eight(colors), np.full(colors.shape[:2], 255, np.uint8)])


def half(data: bytes, w: int, h: int) -> np.ndarray:
    return _eight(np.frombuffer(data, dtype="<f2", count=w * h * 4).reshape(h, w, 4))


def single(data: bytes, w: int, h: int) -> np.ndarray:
    return _eight(np.frombuffer(data, dtype="<f4", count=w * h * 4).reshape(h, w, 4))


def half_red(data: bytes, w: int, h: int) -> np.ndarray:
    return _opaque(np.frombuffer(data, dtype="<f2", count=w * h).reshape(h, w, 1).repeat(3, axis=2))


def small_floats(data: bytes, w: int, h: int) -> np.ndarray:
    """Unsigned floats of 11, 11 and 10 bits, five of them the exponent."""
    v = np.frombuffer(data, dtype="<u4", count=w * h).reshape(h, w)

    def value(bits: np.ndarray, fine: int) -> np.ndarray:
        exponent, rest = (bits >> np.uint32(fine)).astype(np.int32) & 31, (bits & np.uint32((1 << fine) - 1)) / (1 << fine)
        return np.where(exponent == 0, rest * 2.0**-14, (1 + rest) * 2.0 ** (exponent - 15))

    return _opaque(np.dstack([value(v & np.uint32(0x7FF), 6), value(v >> np.uint32(11) & np.uint32(0x7FF), 6), value(v >> np.uint32(22), 5)]))


def shared_exponent(data: bytes, w: int, h: int) -> np.ndarray:
    """Three mantissas of nine bits under one exponent of five."""
    v = np.frombuffer(data, dtype="<u4", count=w * h).reshape(h, w)
    scale = 2.0 ** ((v >> np.uint32(27)).astype(np.int32) - 24)
    return _opaque(np.dstack([(v >> np.uint32(9 * k) & np.uint32(0x1FF)) * scale for k in range(3)]))


#: Bytes of a block (or of a pixel, where blocks are single pixels) and how many pixels wide one is.
UNITS = {
    bc1: (8, 4), bc2: (16, 4), bc3: (16, 4), bc4: (8, 4), bc5: (16, 4), bgra: (4, 1), rgba: (4, 1), rgb: (3, 1), red: (1, 1),
    half: (8, 1), single: (16, 1), half_red: (2, 1), small_floats: (4, 1), shared_exponent: (4, 1),
}
DDS_CODES = {b"DXT1": bc1, b"DXT2": bc2, b"DXT3": bc2, b"DXT4": bc3, b"DXT5": bc3, b"ATI1": bc4, b"BC4U": bc4, b"ATI2": bc5, b"BC5U": bc5}
DXGI_CODES = {2: single, 10: half, 26: small_floats, 28: rgba, 29: rgba, 54: half_red, 61: red, 67: shared_exponent, 70: bc1, 71: bc1, 72: bc1, 73: bc2, 74: bc2, 75: bc2, 76: bc3, 77: bc3, 78: bc3, 79: bc4, 80: bc4, 82: bc5, 83: bc5, 87: bgra, 91: bgra}
VK_CODES = {9: red, 23: rgb, 29: rgb, 37: rgba, 43: rgba, 44: bgra, 50: bgra, 76: half_red, 97: half, 109: single, 122: small_floats, 123: shared_exponent, 131: bc1, 132: bc1, 133: bc1, 134: bc1, 135: bc2, 136: bc2, 137: bc3, 138: bc3, 139: bc4, 141: bc5}


def level_for(w: int, h: int, levels: int, target: int | None) -> int:
    """The last level whose sides both have ``target`` pixels; the first one without a target."""
    level = 0
    while target and level + 1 < levels and min(w >> level + 1, h >> level + 1) >= target:
        level += 1
    return level


def level_bytes(w: int, h: int, unit: int, edge: int) -> int:
    return -(-w // edge) * -(-h // edge) * unit


#: Pairs of bytes, by the first one's place in a block, that files with a reversed code have in the other order.
REVERSED_PAIRS = {bc1: (0, 2), bc4: (0, 2), bc2: (8, 10), bc3: (2, 4, 6, 8, 10), bc5: (2, 4, 6, 10, 12, 14)}


def in_order(data: bytes, read) -> bytes:
    """Bytes of a file with a reversed code, pairs turned round; of formats without blocks, every pair."""
    size = UNITS[read][0] if read in REVERSED_PAIRS else 2
    raw = np.frombuffer(data, dtype=np.uint8, count=len(data) // size * size).reshape(-1, size).copy()
    for k in REVERSED_PAIRS.get(read, (0,)):
        raw[:, [k, k + 1]] = raw[:, [k + 1, k]]
    return raw.tobytes()


def z_order(width: int, height: int) -> np.ndarray:
    """The place of each cell along a Z curve; bits that only the longer side has come last."""
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]
    out, place = np.zeros((height, width), dtype=np.int64), 0
    for bit in range(max(width - 1, height - 1).bit_length()):
        for axis, side in ((x, width), (y, height)):
            if bit < (side - 1).bit_length():
                out |= (axis >> bit & 1) << place
                place += 1
    return out


def in_rows(data: bytes, w: int, h: int, unit: int) -> bytes:
    """Blocks that lie along a Z curve, line by line; blocks beyond the data are zero."""
    places = z_order(-(-w // 4), -(-h // 4)).ravel()
    raw = np.frombuffer(data, dtype=np.uint8, count=len(data) // unit * unit).reshape(-1, unit)
    out = np.zeros((len(places), unit), dtype=np.uint8)
    there = places < len(raw)
    out[there] = raw[places[there]]
    return out.tobytes()


def dds(data: bytes, target: int | None = None, level: int | None = None, face: int = 0) -> np.ndarray | None:
    """A level of a face: ``level``, or the smallest one whose sides have ``target`` pixels.

    Reversed codes mean reversed pairs of bytes. A marker before the blocks says that
    they lie along a Z curve ("CRYF"; such files are read at their first level) or
    that they don't ("FYRC").
    """
    if data[:4] != b"DDS ":
        raise ValueError("no DDS header")
    h, w = struct.unpack_from("<II", data, 12)
    if not (0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS):
        raise ValueError("dimensions out of range")
    levels = max(1, min(struct.unpack_from("<I", data, 28)[0], max(w, h).bit_length()))
    code, bits, at = data[84:88], struct.unpack_from("<I", data, 88)[0], 128
    turned = code[::-1] in DDS_CODES or code == b"01XD"
    code = code[::-1] if turned else code
    if code == b"DX10":
        read, at = DXGI_CODES.get(struct.unpack_from("<I", data, 128)[0]), 148
    else:
        read = DDS_CODES.get(code)
    if read is None and (code == b"DX10" or bits not in (24, 32)):
        return None
    unit, edge = UNITS[read] if read else (bits // 8, 1)
    marker = data[at : at + 4] if edge == 4 else b""
    at += {b"CRYF": 8, b"FYRC": 4}.get(marker, 0)
    if marker == b"CRYF":
        size = level_bytes(w, h, unit, edge)
        if len(data) < at + size:
            raise ValueError("too few blocks")
        body = in_rows(data[at:], w, h, unit)
        return read(in_order(body, read) if turned else body, w, h)
    sizes = [level_bytes(max(1, w >> k), max(1, h >> k), unit, edge) for k in range(levels)]
    level = level_for(w, h, levels, target) if level is None else level
    if not 0 <= level < levels:
        raise ValueError(f"no level {level}")
    at += face * sum(sizes) + sum(sizes[:level])
    w, h = max(1, w >> level), max(1, h >> level)
    if read:
        body = data[at : at + sizes[level]]
        return read(in_order(body, read) if turned else body, w, h)
    texels = np.frombuffer(data, dtype=np.uint8, count=w * h * bits // 8, offset=at).reshape(h, w, bits // 8).astype(np.uint32)
    raw = sum(texels[:, :, k] << np.uint32(8 * k) for k in range(bits // 8))
    masks = struct.unpack_from("<4I", data, 92)
    part = lambda m, other: (raw & m) >> ((m & -m).bit_length() - 1) if m else np.full_like(raw, other)
    return np.stack([part(masks[0], 0), part(masks[1], 0), part(masks[2], 0), part(masks[3], 255)], axis=2).astype(np.uint8)


def ktx2(data: bytes, target: int | None = None, level: int | None = None) -> np.ndarray | None:
    """A level of the first layer and face, stored plain, by Zstandard or by zlib; other formats give None."""
    code, _, w, h, _, _, _, levels, packed = struct.unpack_from("<9I", data, 12)
    read, levels, h = VK_CODES.get(code), max(1, levels), max(1, h)
    if read is None or packed not in (0, 2, 3):
        return None
    if not (0 < w <= MOST_PIXELS and h <= MOST_PIXELS):
        raise ValueError("dimensions out of range")
    level = level_for(w, h, levels, target) if level is None else level
    if not 0 <= level < levels:
        raise ValueError(f"no level {level}")
    at, size, _ = struct.unpack_from("<3Q", data, 80 + 24 * level)
    stored = data[at : at + size]
    if packed:
        stored = inflate(stored, "zstd" if packed == 2 else "zlib")
    w, h = max(1, w >> level), max(1, h >> level)
    if len(stored) < level_bytes(w, h, *UNITS[read]):
        raise ValueError("too few bytes")
    return read(stored, w, h)


#: What turns a picture of each EXIF orientation upright.
TURNS = {
    2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1), 6: lambda a: a.swapaxes(0, 1)[:, ::-1],
    7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: a.swapaxes(0, 1)[::-1],
}


def orientation(head: bytes) -> int:
    """The EXIF orientation that the head of a JPEG file tells, 1 if none."""
    at = head.find(b"Exif\0\0")
    if at < 0 or head[at + 6 : at + 8] not in (b"II", b"MM"):
        return 1
    base, order = at + 6, "<" if head[at + 6 : at + 8] == b"II" else ">"
    try:
        first = base + struct.unpack_from(order + "I", head, base + 4)[0]
        for k in range(struct.unpack_from(order + "H", head, first)[0]):
            tag, _, _, value = struct.unpack_from(order + "HHIH", head, first + 2 + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def jvm_picture(data: bytes) -> np.ndarray:
    """Pixels that the JVM decoded (gray, BGR or BGRA), and the file's head for its orientation."""
    w, h, n = struct.unpack_from(">3I", data, 4)
    v = np.frombuffer(data, dtype=np.uint8, count=w * h * n, offset=16).reshape(h, w, n)
    image = red(v.tobytes(), w, h) if n == 1 else np.dstack([v[:, :, 2], v[:, :, 1], v[:, :, 0], v[:, :, 3] if n == 4 else np.full((h, w), 255, np.uint8)])
    return TURNS.get(orientation(data[16 + w * h * n :]), lambda a: a)(image)


def _unfilter(raw: np.ndarray, n: int) -> np.ndarray:
    """Lines of a PNG pass, each led by its filter; ``n`` bytes a pixel."""
    h, width = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h, width), dtype=np.uint8)
    above = np.zeros(width, dtype=np.int32)
    for y in range(h):
        how, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if how == 2:
            line = (line + above) & 255
        elif how:
            for x in range(width):
                a = line[x - n] if x >= n else 0
                c = above[x - n] if x >= n else 0
                if how == 1:
                    guess = a
                elif how == 3:
                    guess = (a + above[x]) // 2
                else:
                    p = a + above[x] - c
                    guess = min((abs(p - a), 0, a), (abs(p - above[x]), 1, above[x]), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        out[y] = above = line
    return out


def _samples(lines: np.ndarray, w: int, depth: int, n: int) -> np.ndarray:
    """(height, w, n) samples of ``depth`` bits from lines of bytes."""
    if depth == 16:
        return lines.copy().view(">u2").reshape(len(lines), w, n).astype(np.int32)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, : w * n]
        lines = bits @ (1 << np.arange(depth - 1, -1, -1))
    return lines.reshape(len(lines), w, n).astype(np.int32)


#: First column and line, and steps, of the passes of an interlaced PNG.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png(data: bytes) -> np.ndarray | None:
    """Every colour type and depth, interlaced or not; 16-bit samples are rounded to 8."""
    w, h, depth, kind, _, _, lace = struct.unpack_from(">IIBBBBB", data, 16)
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if n is None or depth not in (1, 2, 4, 8, 16) or not (0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS):
        return None
    at, chunks = 8, {b"IDAT": b"", b"PLTE": b"", b"tRNS": b""}
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name in chunks:
            chunks[name] += data[at + 8 : at + 8 + size]
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), dtype=np.uint8)
    passes = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (ADAM7 if lace else ((0, 0, 1, 1),)) if w > x and h > y]
    sizes = [ph * (1 + -(-pw * n * depth // 8)) for *_, pw, ph in passes]
    if sum(sizes) > len(raw):
        raise ValueError("too few pixels")
    v, at = np.zeros((h, w, n), dtype=np.int32), 0
    for (x, y, dx, dy, pw, ph), size in zip(passes, sizes):
        v[y::dy, x::dx] = _samples(_unfilter(raw[at : at + size].reshape(ph, -1), max(1, n * depth // 8)), pw, depth, n)
        at += size
    clear = chunks[b"tRNS"]
    if kind == 3:
        palette = np.full((len(chunks[b"PLTE"]) // 3, 4), 255, dtype=np.uint8)
        palette[:, :3] = np.frombuffer(chunks[b"PLTE"], dtype=np.uint8).reshape(-1, 3)
        palette[: len(clear), 3] = np.frombuffer(clear[: len(palette)], dtype=np.uint8)
        return palette[v[:, :, 0]]
    hole = (v == np.frombuffer(clear, dtype=">u2")).all(axis=2) if clear and n in (1, 3) else None
    v = ((v + 128) // 257 if depth == 16 else v * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rgb = v[:, :, :1].repeat(3, axis=2) if n < 3 else v[:, :, :3]
    alpha = v[:, :, -1:].copy() if n in (2, 4) else np.full((h, w, 1), 255, dtype=np.uint8)
    if hole is not None:
        alpha[hole] = 0
    return np.concatenate([rgb, alpha], axis=2)


def _pixels(raw: np.ndarray, bits: int) -> np.ndarray:
    """(pixels, bytes a pixel) of TGA's or BMP's little-endian colours as RGBA."""
    out = np.full((len(raw), 4), 255, dtype=np.uint8)
    if bits in (15, 16):
        v = raw.copy().view("<u2")[:, 0].astype(np.int32)
        for c, shift in enumerate((10, 5, 0)):
            part = v >> shift & 31
            out[:, c] = part << 3 | part >> 2
    elif bits == 8:
        out[:, :3] = raw
    else:
        out[:, :3] = raw[:, 2::-1]
        if bits == 32:
            out[:, 3] = raw[:, 3]
    return out


def tga(data: bytes) -> np.ndarray | None:
    """Palettes, colours and gray, plain or run-length encoded, from any corner."""
    skip, mapped, kind, first, count, map_bits, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    if kind not in (1, 2, 3, 9, 10, 11) or bits not in ((8, 16) if kind & 3 == 1 else (15, 16, 24, 32) if kind & 3 == 2 else (8,)) or not (w and h):
        return None
    n, at, want = -(-bits // 8), 18 + skip, w * h
    if mapped:
        size = -(-map_bits // 8)
        table = np.frombuffer(data, dtype=np.uint8, count=count * size, offset=at).reshape(count, size)
        at += count * size
    if kind < 8:
        raw = data[at : at + want * n]
    else:
        raw = bytearray()
        while len(raw) < want * n:
            run = (data[at] & 127) + 1
            step = n if data[at] & 128 else run * n
            raw += data[at + 1 : at + 1 + step] * (run if data[at] & 128 else 1)
            at += 1 + step
    texels = np.frombuffer(bytes(raw[: want * n]), dtype=np.uint8).reshape(want, n)
    if kind & 3 == 1:
        if not mapped or map_bits not in (15, 16, 24, 32):
            return None
        index = (texels[:, 0] if n == 1 else texels.copy().view("<u2")[:, 0]).astype(np.int64) - first
        if index.min() < 0:
            raise ValueError("an index below the palette")
        image = _pixels(table, map_bits)[index].reshape(h, w, 4)
    else:
        image = _pixels(texels, bits).reshape(h, w, 4)
    image = image if flags & 0x20 else image[::-1]
    return image[:, ::-1] if flags & 0x10 else image


def bmp(data: bytes) -> np.ndarray | None:
    """Uncompressed pictures of 1, 4, 8, 16, 24 and 32 bits; other masks and run lengths give None."""
    start, head = struct.unpack_from("<II", data, 10)
    if head < 40:
        return None
    w, h, _, bits, packed, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    flip, h = h > 0, abs(h)
    if packed or bits not in (1, 4, 8, 16, 24, 32) or not (0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS):
        return None
    stride = -(-w * bits // 32) * 4
    lines = np.frombuffer(data, dtype=np.uint8, count=h * stride, offset=start).reshape(h, stride)
    if bits <= 8:
        table = np.frombuffer(data, dtype=np.uint8, count=4 * (used or 1 << bits), offset=14 + head).reshape(-1, 4)
        image = _pixels(table[:, :3], 24)[_samples(lines, w if bits == 8 else stride * 8 // bits, bits, 1)[:, :w, 0]] if bits < 8 else _pixels(table[:, :3], 24)[lines[:, :w]]
    else:
        n = bits // 8
        image = _pixels(np.ascontiguousarray(lines[:, : w * n]).reshape(w * h, n), bits).reshape(h, w, 4)
        image[:, :, 3] = 255
    return image[::-1] if flip else image


def radiance(data: bytes) -> np.ndarray | None:
    """(height, width, 3) linear colours of a Radiance picture, its lines plain or in runs."""
    at = data.index(b"\n\n") + 2
    end = data.index(b"\n", at)
    words = data[at:end].split()
    if len(words) != 4 or words[0] != b"-Y" or words[2] != b"+X":
        return None
    h, w, at = int(words[1]), int(words[3]), end + 1
    if not (0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS):
        raise ValueError("dimensions out of range")
    out = np.zeros((h, w, 4), dtype=np.uint8)
    for y in range(h):
        if 8 <= w < 0x8000 and data[at : at + 2] == b"\2\2" and struct.unpack_from(">H", data, at + 2)[0] == w:
            at += 4
            for c in range(4):
                line = bytearray()
                while len(line) < w:
                    n = data[at]
                    line += data[at + 1 : at + 2] * (n - 128) if n > 128 else data[at + 1 : at + 1 + n]
                    at += 2 if n > 128 else 1 + n
                    if not n:
                        raise ValueError("an empty run")
                out[y, :, c] = np.frombuffer(bytes(line[:w]), dtype=np.uint8)
        else:
            line, shift = bytearray(), 0
            while len(line) < 4 * w:
                pixel = data[at : at + 4]
                if len(pixel) < 4:
                    raise ValueError("too few pixels")
                at += 4
                if pixel[:3] == b"\1\1\1":
                    line += line[-4:] * (pixel[3] << shift)
                    shift += 8
                else:
                    line += pixel
                    shift = 0
                if not line:
                    raise ValueError("a run of nothing")
            out[y] = np.frombuffer(bytes(line[: 4 * w]), dtype=np.uint8).reshape(w, 4)
    return out[:, :, :3] * np.where(out[:, :, 3:] > 0, 2.0 ** (out[:, :, 3:].astype(np.int32) - 136), 0.0)


def exposed(linear: np.ndarray) -> np.ndarray:
    """Linear colours as bytes: exposed to middle grey, the filmic curve, then sRGB, as ``operators.tonemap`` has them for pixels in rows."""
    y = linear @ np.array([0.2126, 0.7152, 0.0722])
    lit = y[np.isfinite(y)]
    mean = 2.0 ** (np.log2(np.maximum(lit, 0) + 1e-5).sum() / max(1, y.size))
    c = linear * (np.clip(0.18 / mean, 0.01, 100) if mean > 1e-5 else 1.0)
    c = np.clip(c * (c * 2.51 + 0.03) / (c * (c * 2.43 + 0.59) + 0.14), 0, 1)
    return _opaque(np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.power(c, 1 / 2.4) - 0.055))


def hdr(data: bytes) -> np.ndarray | None:
    linear = radiance(data)
    return None if linear is None else exposed(linear)


def decode(path: str, data: bytes, target: int | None = None, level: int | None = None) -> np.ndarray | None:
    """A raster, or None where there is no decoder for the bytes.

    Of files with mipmaps it is ``level``, or the smallest level whose sides have
    ``target`` pixels, or the first.
    """
    try:
        if data[:4] == b"qoif":
            return qoi(data)
        if data[:4] == b"DDS ":
            return dds(data, target, level)
        if data[:12] == b"\xabKTX 20\xbb\r\n\x1a\n":
            return ktx2(data, target, level)
        if data[:4] == b"JIMG" and extension_of(path) in ("jpg", "jpeg", "gif"):
            return jvm_picture(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png(data)
        if data[:2] == b"BM" and extension_of(path) == "bmp":
            return bmp(data)
        if data[:10] == b"#?RADIANCE" or data[:6] == b"#?RGBE":
            return hdr(data)
        if extension_of(path) == "tga":
            return tga(data)
        if extension_of(path) in ("gz", "svgz"):
            return None
    except (ValueError, IndexError, KeyError, struct.error, zlib.error, OverflowError, MemoryError):
        return None
    return None


# Reduction and hashing


def _weights(old: int, new: int, how: str) -> np.ndarray:
    """What each old pixel of a line counts for each new one."""
    scale = old / new
    centre = (np.arange(new) + 0.5) * scale
    if how == "nearest":
        return np.eye(old)[np.minimum(np.floor(centre), old - 1).astype(np.int64)]
    away = (np.arange(old)[None, :] - centre[:, None] + 0.5) / max(1.0, scale)
    w = np.clip(1 - np.abs(away), 0, None) if how == "triangle" else np.where(np.abs(away) < 3, np.sinc(away) * np.sinc(away / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, how: str = "triangle") -> np.ndarray:
    """Another size by the nearest pixel, or a triangle or Lanczos filter that widens as the picture shrinks; halves are rounded up."""
    out = np.einsum("yh,hwc->ywc", _weights(image.shape[0], height, how), image.astype(np.float64), optimize=True)
    out = np.einsum("xw,ywc->yxc", _weights(image.shape[1], width, how), out, optimize=True)
    return np.clip(np.floor(np.round(out, 6) + 0.5), 0, 255).astype(np.uint8)


def triangle(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return resize(image, width, height)


def fitted(image: np.ndarray, side: int, how: str = "triangle") -> np.ndarray:
    """A picture whose longer side has at most ``side`` pixels, in its own proportions."""
    h, w = image.shape[:2]
    if max(w, h) <= side:
        return image
    scale = min(side / w, side / h)
    return resize(image, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)), how)


def with_aspect(image: np.ndarray, ratio: float) -> np.ndarray:
    """A picture stretched to ``ratio`` times its width; within a hundredth of 1 it stays."""
    return image if abs(ratio - 1) < 1e-2 else resize(image, int(max(1.0, image.shape[1] * ratio)), image.shape[0])


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit RGBA picture as a PNG file."""
    h, w = image.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 4)], axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def dhash(gray: np.ndarray, signed: bool = False) -> int:
    """64 bits of a (8, 9) gray picture: bit y * 8 + x is set if a pixel is brighter than its right neighbour."""
    v = gray.astype(np.uint8).view(np.int8) if signed else gray.astype(np.int32)
    bits = (v[:, :8] > v[:, 1:9]).reshape(64)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def channel(image: np.ndarray, name: str, least_range: int | None = None) -> np.ndarray | None:
    """One view of a raster as gray; a flat channel gives None if ``least_range`` is set."""
    rgb, alpha = image[:, :, :3].astype(np.float64), image[:, :, 3].astype(np.float64)
    if name in "RGBA":
        v = image[:, :, "RGBA".index(name)]
        return None if least_range is not None and int(v.max()) - int(v.min()) < least_range else v
    if name == "Composite" and alpha.min() < 255 and not ((alpha > 10).mean() <= 0.001 and rgb.max() > 0):
        rgb = np.floor(rgb * (alpha / 255)[:, :, None] + 128 * (1 - alpha / 255)[:, :, None])
    return np.rint(rgb @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def perceptual_hash(image: np.ndarray, name: str = "Composite", least_range: int | None = None) -> int | None:
    gray = channel(triangle(image, 9, 8), name, least_range)
    return None if gray is None else dhash(gray)
