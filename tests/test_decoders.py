"""Plain formats, and what has no decoder."""

import struct
import zlib

import numpy as np
import pytest

from assetlode.sources import decoders

RGBA = np.random.default_rng(1).integers(0, 256, (5, 6, 4)).astype(np.uint8)
RGB = np.concatenate([RGBA[:, :, :3], np.full((5, 6, 1), 255, np.uint8)], axis=2)


def png(w, h, depth, kind, raw, lace=0, extra=()):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + bytes(4)
    body = b"".join(chunk(n, d) for n, d in [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, lace)), *extra, (b"IDAT", zlib.compress(raw)), (b"IEND", b"")])
    return b"\x89PNG\r\n\x1a\n" + body


def test_png_kinds():
    lines = lambda v: b"".join(b"\0" + r.tobytes() for r in v)
    assert (decoders.png(png(6, 5, 16, 6, lines((RGBA.astype(">u2") * 257).astype(">u2")))) == RGBA).all()
    laced = b"".join(lines(np.ascontiguousarray(RGBA[y::dy, x::dx])) for x, y, dx, dy in decoders.ADAM7 if x < 6 and y < 5)
    assert (decoders.png(png(6, 5, 8, 6, laced, 1)) == RGBA).all()
    out = decoders.png(png(3, 1, 4, 3, b"\0\x01\x20", extra=[(b"PLTE", bytes(range(9))), (b"tRNS", b"\x07")]))
    assert out.tolist() == [[[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255]]]
    assert decoders.png(png(3, 1, 1, 0, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255]


@pytest.mark.parametrize("top", [0, 0x20])
def test_tga(top):
    head = lambda kind, bits, mapped=0, n=0: struct.pack("<BBBHHBHHHHBB", 0, mapped, kind, 0, n, 24, 0, 0, 6, 5, bits, top)
    put = RGBA if top else RGBA[::-1]
    assert (decoders.decode("a.tga", head(2, 32) + put[:, :, [2, 1, 0, 3]].tobytes()) == RGBA).all()
    assert (decoders.decode("a.tga", head(2, 24) + put[:, :, [2, 1, 0]].tobytes()) == RGB).all()
    assert (decoders.decode("a.tga", head(10, 24) + bytes([128 | 29, 1, 2, 3]))[:, :, :3] == [3, 2, 1]).all()
    assert (decoders.decode("a.tga", head(3, 8) + put[:, :, 0].tobytes())[:, :, 1] == RGBA[:, :, 0]).all()
    assert (decoders.decode("a.tga", head(1, 8, 1, 2) + bytes([0, 0, 0, 1, 2, 3]) + b"\1" * 30)[:, :, :3] == [3, 2, 1]).all()
    assert decoders.decode("a.tga", head(10, 24) + b"\x80") is None


def test_bmp_and_dds():
    head = lambda bits, used=0: b"BM" + struct.pack("<IIIIiiHHIIiiII", 0, 0, 54 + 4 * used, 40, 6, 5, 1, bits, 0, 0, 0, 0, used, 0)
    lines = b"".join(r.tobytes() + bytes(2) for r in RGBA[::-1, :, [2, 1, 0]])
    assert (decoders.decode("a.bmp", head(24) + lines) == RGB).all()
    assert (decoders.decode("a.bmp", head(8, 2) + bytes([0, 0, 0, 0, 1, 2, 3, 0]) + (b"\1" * 6 + bytes(2)) * 5)[:, :, :3] == [3, 2, 1]).all()
    assert decoders.decode("a.bmp", head(1, 2) + bytes([0, 0, 0, 0, 1, 2, 3, 0]) + b"\x40\0\0\0" * 5)[0, :, 0].tolist() == [0, 3, 0, 0, 0, 0]
    dds = bytearray(128)
    dds[:4] = b"DDS "
    struct.pack_into("<II", dds, 12, 5, 6)
    struct.pack_into("<5I", dds, 88, 24, 0xFF0000, 0xFF00, 0xFF, 0)
    assert (decoders.decode("a.dds", bytes(dds) + RGBA[:, :, [2, 1, 0]].tobytes()) == RGB).all()


def blocks_file(w, h, code, body):
    head = bytearray(128)
    head[:4], head[84:88] = b"DDS ", code
    struct.pack_into("<II", head, 12, h, w)
    return bytes(head) + body


def test_z_order():
    assert decoders.z_order(4, 4).tolist() == [[0, 1, 4, 5], [2, 3, 6, 7], [8, 9, 12, 13], [10, 11, 14, 15]]
    assert decoders.z_order(8, 2).tolist() == [[0, 1, 4, 5, 8, 9, 12, 13], [2, 3, 6, 7, 10, 11, 14, 15]]
    assert decoders.z_order(1, 4).ravel().tolist() == [0, 1, 2, 3] and decoders.z_order(1, 1).tolist() == [[0]]
    for w, h in ((16, 4), (2, 32), (8, 8)):
        assert sorted(decoders.z_order(w, h).ravel()) == list(range(w * h))


@pytest.mark.parametrize("code, unit", [(b"DXT1", 8), (b"DXT3", 16), (b"DXT5", 16), (b"ATI1", 8), (b"ATI2", 16)])
def test_swizzled_and_reversed_blocks(code, unit):
    w, h = 32, 16
    blocks = np.random.default_rng(3).integers(0, 256, (h // 4, w // 4, unit)).astype(np.uint8)
    want = decoders.dds(blocks_file(w, h, code, blocks.tobytes()))
    along = np.empty((blocks.shape[0] * blocks.shape[1], unit), np.uint8)
    along[decoders.z_order(w // 4, h // 4).ravel()] = blocks.reshape(-1, unit)
    assert (decoders.dds(blocks_file(w, h, code, b"CRYF" + bytes(4) + along.tobytes())) == want).all()
    assert (decoders.dds(blocks_file(w, h, code, b"FYRC" + blocks.tobytes())) == want).all()
    read = decoders.DDS_CODES[code]
    turned = decoders.in_order(blocks.tobytes(), read)
    assert turned != blocks.tobytes() and decoders.in_order(turned, read) == blocks.tobytes()
    assert (decoders.dds(blocks_file(w, h, code[::-1], turned)) == want).all()
    turned_along = decoders.in_order(along.tobytes(), read)
    assert (decoders.dds(blocks_file(w, h, code[::-1], b"CRYF" + bytes(4) + turned_along)) == want).all()
    assert decoders.decode("a.dds", blocks_file(w, h, code, b"CRYF" + bytes(4) + along.tobytes()[:-unit])) is None


def test_what_has_no_decoder_is_listed(spark, tmp_path):
    from assetlode.plans.params import ScanParams, scan

    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "b.tga").write_bytes(struct.pack("<BBBHHBHHHHBB", 0, 0, 3, 0, 0, 0, 0, 0, 2, 2, 8, 0) + bytes(4))
    out = scan(spark, ScanParams(str(tmp_path), method="perceptual")).undecoded.collect()
    assert [(r.path.rpartition("/")[2], bool(r.reason)) for r in out] == [("a.jpg", True)]
