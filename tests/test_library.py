"""Operators on synthetic inputs: joins against brute force, components against union-find, files made on the spot."""

from __future__ import annotations

import gzip
import os
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetlode import cli
from assetlode.functions import encoders
from assetlode.functions.scalars import decode_uri, max_distance
from assetlode.operators import actions, cache, dups, pairs, views
from assetlode.operators.components import connected_components, least_of_components
from assetlode.operators.pairs import cell_pairs, cosine_pairs, hamming_edges
from assetlode.operators.skew import rank_in_groups
from assetlode.plans.params import ScanParams, scan
from assetlode.sources import decoders, headers, scan as scanning
from assetlode.streaming.ingest import ingest

# Pairs and components


def test_banded_and_blocked_joins_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 64)
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(150)]
    hashes += [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in hashes[:60]]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    frame = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    for d in (0, 3, 6, 10, 20):
        want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (hashes[a] ^ hashes[b]).bit_count() <= d}
        assert {tuple(r) for r in pairs.hamming_pairs(frame, d).collect()} == want


def test_cosine_join_and_its_neighbour_limit(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    v = np.random.default_rng(0).normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "id long, v array<double>")
    found = {(r.a, r.b) for r in pairs.cosine_pairs(frame, 0.5).collect()}
    assert found == {(a, b) for a in range(60) for b in range(a + 1, 60) if v[a] @ v[b] >= 0.5}
    assert {(r.a, r.b) for r in pairs.cosine_pairs(frame, 0.5, 1).collect()} <= found


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    for edges in ([(k, k + 1) for k in range(200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, k) for k in range(1, 100)], [(5, 5)]):
        root = list(range(400))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
        frame = spark.createDataFrame(edges, "src long, dst long")
        assert {r.node: r.component for r in connected_components(frame).collect()} == want


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=72, max_size=72), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_hash_properties(raw, a, b, c):
    gray = np.frombuffer(raw, np.uint8).reshape(8, 9)
    want = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if gray[y, x] > gray[y, x + 1])
    assert decoders.dhash(gray) & (2**64 - 1) == want
    d = lambda p, q: (p ^ q).bit_count()
    assert d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)


def test_similarity_and_distance():
    assert [max_distance(s) for s in (100, 90, 75, 0)] == [0, 6, 16, 64]


def test_selection_algebra(spark):
    rows = [("g1", f"/a/{k}.png", k + 1, 10 - k, 100.0 - k) for k in range(4)] + [("g2", "/b/0.png", 1, 5, 100.0), ("g2", "/b/1.png", 2, 5, 90.0)]
    g = spark.createDataFrame(rows, "group_id string, path string, rank int, file_size long, similarity double").withColumn("is_best", F.col("rank") == 1)
    marked = g.where("rank = 2")
    inverted = views.select_invert(g, marked)
    assert {r.path for r in views.select_invert(g, inverted).collect()} == {r.path for r in marked.collect()}
    assert views.select_none(g).count() == 0 and views.without_path(g, "\\B\\0.png").select("group_id").distinct().count() == 1
    assert {tuple(r) for r in views.link_pairs(g, marked).collect()} == {("/a/0.png", "/a/1.png"), ("/b/0.png", "/b/1.png")}
    # the best may be filtered away while its group stays
    assert {r.path for r in views.filtered_groups(g, "1.png").collect()} == set()
    assert views.page(g, 6, 1, 9, F.asc("path")).count() == 6


def test_semantic_groups_need_two_paths(spark):
    rows = [(1, "/a", [1.0, 0.0], 4, 4, 1), (2, "/a", [1.0, 0.0], 4, 4, 1), (3, "/b", [0.0, 1.0], 4, 4, 1), (4, "/c", [0.05, 1.0], 8, 4, 1)]
    g = dups.semantic_groups(spark.createDataFrame(rows, "id long, path string, v array<double>, width int, height int, file_size int"), 0.9)
    assert {(r.path, r.rank) for r in g.collect()} == {("/c", 1), ("/b", 2)}


# Files


def png(image: np.ndarray, filters=(0,)) -> bytes:
    h, w, n = image.shape
    lines = b""
    above = np.zeros(w * n, np.int32)
    for y in range(h):
        line, how = image[y].reshape(-1).astype(np.int32), filters[y % len(filters)]
        left, corner = np.concatenate([np.zeros(n, np.int32), line[:-n]]), np.concatenate([np.zeros(n, np.int32), above[:-n]])
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        lines += bytes([how]) + ((line - [0, left, above, (left + above) // 2, paeth][how]) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6, 1: 0, 2: 4}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def dds(w, h, code=b"DXT1", flags=4, mips=0, caps2=0, bits=0, extra=b"", payload=b"", masks=(0, 0, 0, 0)) -> bytes:
    head = bytearray(128)
    head[:4] = b"DDS "
    struct.pack_into("<I", head, 4, 124)
    struct.pack_into("<II", head, 12, h, w)
    struct.pack_into("<I", head, 28, mips)
    struct.pack_into("<I", head, 80, flags)
    head[84:88] = code
    struct.pack_into("<I4I", head, 88, bits, *masks)
    struct.pack_into("<I", head, 112, caps2)
    return bytes(head) + extra + payload


def test_headers():
    p = lambda name, data: headers.probe(name, data)
    m = p("/x/a.DDS", dds(64, 32, b"DXT5", mips=3, caps2=0xFE00))
    assert (m["width"], m["height"], m["compression_format"], m["has_alpha"], m["mipmap_count"], m["is_cubemap"]) == (64, 32, "DXT5", True, 3, True)
    m = p("a.dds", dds(8, 8, b"DX10", extra=struct.pack("<5I", 98, 3, 0, 1, 0)))
    assert (m["compression_format"], m["color_space"], m["has_alpha"]) == ("BC7", "Linear", True)
    assert p("a.dds", dds(8, 8, b"\0\0\0\0", flags=65, bits=24))["bit_depth"] == 6
    assert p("a.dds", dds(0, 8))["error"] and p("a.dds", b"")["width"] == 0
    m = p("a.qoi", b"qoif" + struct.pack(">IIBB", 7, 9, 4, 0))
    assert (m["width"], m["height"], m["has_alpha"]) == (7, 9, True)
    m = p("a.astc", b"\x13\xab\xa1\x5c\x06\x06\x01" + (300).to_bytes(3, "little") + (200).to_bytes(3, "little") + b"\1\0\0")
    assert (m["width"], m["height"], m["compression_format"]) == (300, 200, "ASTC 6x6")
    m = p("a.pvr", struct.pack("<13I", 0x03525650, 0, 0, 0, 0, 0, 16, 32, 0, 0, 0, 5, 0))
    assert (m["width"], m["height"], m["mipmap_count"]) == (32, 16, 5)
    assert p("a.pvr", struct.pack("<11I", 0, 10, 20, *[0] * 8) + b"PVR!" + bytes(8))["width"] == 20
    m = p("a.psd", b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 40, 30, 16, 4))
    assert (m["width"], m["height"], m["bit_depth"], m["color_space"]) == (30, 40, 16, "CMYK")
    assert (p("a.atc", b"ATC " + struct.pack("<III", 12, 8, 1))["width"], p("a.atc", bytes(256))["width"], p("a.atc", bytes(128))["width"], p("a.atc", bytes(7))["width"]) == (12, 16, 16, 0)
    svg = b'<svg xmlns="x" width="30px" height="20"></svg>'
    assert [p("a.svgz", d)["width"] for d in (svg, gzip.compress(svg), b"<svg viewBox='0 0 5 6'>", b"nothing")] == [30, 30, 5, 512]
    m = p("a.ktx2", b"\xabKTX 20\xbb\r\n\x1a\n" + struct.pack("<9I", 131, 1, 64, 0, 0, 0, 6, 4, 2) + bytes(32))
    assert (m["width"], m["height"], m["compression_format"], m["is_cubemap"], m["mipmap_count"]) == (64, 1, "KTX2 (Zstandard)", True, 4)
    m = p("a.crn", b"Hx" + bytes(10) + struct.pack(">HHBB", 33, 44, 2, 1))
    assert (m["width"], m["height"], m["mipmap_count"]) == (33, 44, 2)
    attribute = lambda n, t, v: n + b"\0" + t + b"\0" + struct.pack("<I", len(v)) + v
    exr = b"\x76\x2f\x31\x01\2\0\0\0" + attribute(b"channels", b"chlist", b"A\0" + bytes(16) + b"R\0" + bytes(16) + b"\0") + attribute(b"compression", b"compression", b"\4") + attribute(b"displayWindow", b"box2i", struct.pack("<4i", 0, 0, 9, 4)) + b"\0"
    m = p("a.exr", exr)
    assert (m["width"], m["height"], m["compression_format"], m["has_alpha"], m["color_space"]) == (10, 5, "EXR (PIZ)", True, "Linear")
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    ipco = box(b"ipco", box(b"ispe", bytes(4) + struct.pack(">II", 640, 480)) + box(b"colr", b"nclx" + struct.pack(">HHHB", 12, 13, 1, 0)))
    m = p("a.heic", box(b"ftyp", b"heic" + bytes(4)) + box(b"meta", bytes(4) + box(b"iprp", ipco)))
    assert (m["width"], m["height"], m["color_space"]) == (640, 480, "Display P3")
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 123) + struct.pack("<HHII", 257, 4, 1, 45) + bytes(4)
    assert (p("a.nef", tiff)["width"], p("a.tif", tiff)["height"], p("a.nef", tiff)["compression_format"]) == (123, 45, "Camera RAW (NEF)")
    # 1 bit small, 5 bits height / 8 - 1, 3 bits ratio 0, 5 bits width / 8 - 1
    assert (p("a.jxl", b"\xff\x0a" + (1 | 3 << 1 | 0 << 6 | 7 << 9).to_bytes(4, "little"))["width"], p("a.jxl", b"\xff\x0a" + (1 | 3 << 1 | 7 << 6).to_bytes(4, "little"))["width"]) == (64, 64)
    jpg = b"\xff\xd8\xff\xe0\0\4xx\xff\xc0" + struct.pack(">HBHHB", 17, 8, 50, 60, 3) + bytes(12)
    assert (p("a.jpg", jpg)["width"], p("a.jpg", jpg)["height"]) == (60, 50)
    m = p("a.uasset", b"..Texture2D..NORMAL.." + jpg)
    assert (m["width"], m["color_space"]) == (60, "Linear")
    assert p("a.hdr", b"#?RADIANCE\nFORMAT=x\n\n-Y 12 +X 34\n")["bit_depth"] == 32
    assert p("a.gif", b"GIF89a" + struct.pack("<HH", 5, 6))["height"] == 6 and p("a.xyz", b"1")["error"] and p(".png", b"")["error"]
    assert p("a.tga", bytes(12) + struct.pack("<HHBB", 3, 4, 32, 8))["has_alpha"] and p("a.ico", b"\0\0\1\0\1\0\0\x10" + bytes(8))["width"] == 256
    assert p("a.bmp", b"BM" + bytes(16) + struct.pack("<iiHH", 5, -6, 1, 32))["height"] == 6


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(sorted(headers.BY_EXTENSION)))
def test_probe_never_raises(data, ext):
    for head in (b"", b"DDS ", b"\x89PNG\r\n\x1a\n", b"\xff\xd8", b"RIFF0000WEBP", b"\xff\x0a", b"\x76\x2f\x31\x01", b"II*\0", b"8BPS", b"\x1f\x8b"):
        headers.probe(f"x.{ext}", head + data)
        decoders.decode(f"x.{ext}", head + data)


def test_decoders():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (11, 7, 4)).astype(np.uint8)
    assert (decoders.png(png(image, (0, 1, 2, 3, 4))) == image).all()
    gray = decoders.png(png(image[:, :, :1]))
    assert (gray[:, :, 1] == image[:, :, 0]).all() and (gray[:, :, 3] == 255).all()
    # QOI: rgba, run, index, diff, luma, rgb
    stream = b"qoif" + struct.pack(">IIBB", 8, 1, 4, 0) + bytes([0xFF, 10, 20, 30, 40, 0xC1, 0x40 | 3 << 4 | 2 << 2 | 1, 0x80 | 33, 0x88, 0xFE, 1, 2, 3, 0xC0]) + bytes([(10 * 3 + 20 * 5 + 30 * 7 + 40 * 11) % 64])
    px = decoders.qoi(stream)[0].tolist()
    assert px == [[10, 20, 30, 40]] * 3 + [[11, 20, 29, 40], [12, 21, 30, 40], [1, 2, 3, 40], [1, 2, 3, 40], [10, 20, 30, 40]]
    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11_10_01_00)
    out = decoders.bc1(block, 4, 4)
    assert out[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    assert decoders.bc1(struct.pack("<HHI", 0, 1, 0xFFFFFFFF), 4, 4)[0, 0, 3] == 0
    ramp = bytes([200, 100]) + (0b010_001_000).to_bytes(6, "little")
    assert decoders.bc4(ramp, 4, 4)[0, :3, 0].tolist() == [200, 100, (6 * 200 + 100) // 7]
    assert decoders.bc3(ramp + block, 4, 4)[0, 1].tolist() == [0, 0, 255, 100]
    assert decoders.bc2(bytes([0xF0]) + bytes(7) + block, 4, 4)[0, :2, 3].tolist() == [0, 255]
    assert decoders.bc5(ramp + ramp, 4, 4)[0, 1, :2].tolist() == [100, 100]
    assert (decoders.dds(dds(4, 4, payload=block)) == out).all()
    pixel = decoders.dds(dds(1, 1, b"\0\0\0\0", flags=65, bits=32, payload=bytes([1, 2, 3, 4]), masks=(0xFF0000, 0xFF00, 0xFF, 0xFF000000)))
    assert pixel[0, 0].tolist() == [3, 2, 1, 4]
    assert decoders.inflate(zlib.compress(b"x"), "zlib") == decoders.inflate(gzip.compress(b"x"), "gzip") == b"x"
    import zstandard

    assert decoders.inflate(zstandard.compress(b"y" * 9), "zstd") == b"y" * 9
    flat = np.full((20, 20, 4), 90, np.uint8)
    assert (decoders.triangle(flat, 9, 8) == 90).all() and decoders.perceptual_hash(flat, "R", 5) is None and decoders.perceptual_hash(flat) == 0
    assert decoders.decode("a.jxl", b"\xff\x0a") is None


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(4)
    a = np.kron(rng.integers(0, 256, (6, 6, 4)), np.ones((12, 12, 1))).astype(np.uint8)
    a[:, :, 3] = 255
    b = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    b[:, :, 3] = 255
    (tmp_path / "sub dir+x").mkdir()
    (tmp_path / "Cache").mkdir()
    files = {"a.png": png(a), "sub dir+x/copy of a.PNG": png(a), "near.png": png(b), "other.png": png(255 - a), "Cache/a.png": png(a), "empty.png": b"", "note.txt": b"hi", "t.dds": dds(6, 6, b"DXT1", payload=bytes(32))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_scans_of_real_files(spark, folder, tmp_path):
    found = scanning.files(spark, folder, ["png"], ["cache"])
    assert {os.path.relpath(r.path, folder) for r in found.collect()} == {"a.png", "sub dir+x/copy of a.PNG", "near.png", "other.png"}  # Spark lists no empty files
    base = ScanParams(folder=folder, extensions=("png", "dds"))
    groups = scan(spark, base).groups.collect()
    assert {os.path.basename(r.path) for r in groups} == {"a.png", "copy of a.PNG"} and sum(r.is_best for r in groups) == 1
    rows = {os.path.basename(r.path): r for r in scan(spark, ScanParams(**{**base.__dict__, "method": "inventory"})).inventory.collect()}
    assert rows["t.dds"].compression_format == "DXT1" and rows["a.png"].width == 72
    issues = {(os.path.basename(r.path), r.issue) for r in scan(spark, ScanParams(**{**base.__dict__, "method": "qc"})).issues.collect()}
    assert ("t.dds", "Bad Block Alignment (Not divisible by 4)") in issues and ("a.png", "Missing Mipmaps") in issues
    near = scan(spark, ScanParams(**{**base.__dict__, "method": "perceptual"})).groups.collect()
    assert {os.path.basename(r.path) for r in near} == {"a.png", "copy of a.PNG", "near.png"}
    alike = scan(spark, ScanParams(**{**base.__dict__, "method": "ai", "similarity": 99.0})).groups.collect()
    assert {os.path.basename(r.path) for r in alike} >= {"a.png", "near.png"}
    hits = scan(spark, ScanParams(**{**base.__dict__, "method": "ai", "query": "red stone"})).groups
    assert [r.rank for r in hits.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    compared = scan(spark, ScanParams(**{**base.__dict__, "method": "qc", "folder_b": folder})).issues
    assert compared.count() == 0
    base.save(tmp_path / "p.json")
    assert ScanParams.load(tmp_path / "p.json") == base
    with pytest.raises(NotADirectoryError):
        scan(spark, ScanParams(folder=folder + "/nowhere"))
    with pytest.raises(ValueError):
        scan(spark, ScanParams(folder=folder, method="what"))
    assert scanning.rasters(scanning.files(spark, folder, ["png"], contents=True)).groupBy("img").count().where("count = 72 * 72").count() == 5
    assert scanning.warnings(spark, folder).count() == 0


def test_content_hash_and_record_id(spark):
    import xxhash

    frame = spark.createDataFrame([("/a", 3, bytearray(b"abc"))], "path string, file_size long, content binary")
    assert scanning.content_hashes(frame).first().content_hash == format(xxhash.xxh64_intdigest(b"abc"), "x")
    assert frame.select(scanning.record_id(F.col("path"), F.lit("R"))).first()[0] == f"{xxhash.xxh64_intdigest('/aR'):016x}"


def test_uri_decoding(spark):
    rows = spark.createDataFrame([("file:///a%20b+c%2B",)], "u string").select(decode_uri(F.col("u")).alias("p"))
    assert rows.first().p == "/a b+c+"


def test_actions(spark, folder):
    groups = scan(spark, ScanParams(folder=folder, extensions=("png",))).groups.withColumnRenamed("content_hash", "group_id")
    todo = actions.plan(groups, groups, "hardlink")
    (row,) = todo.collect()
    assert actions.carry_out(todo)[0][2] == "planned" and not os.path.samefile(row.path, row.original)
    assert actions.carry_out(todo, dry_run=False)[0][2] == "done" and os.path.samefile(row.path, row.original)
    trash = actions.plan(groups, groups.where("rank > 1"), "trash")
    assert actions.carry_out(trash, folder + "/bin", dry_run=False)[0][2] == "done" and not os.path.exists(row.path)
    with pytest.raises(ValueError):
        actions.plan(groups, groups, "burn")


def test_vector_store_and_stream(spark, folder, tmp_path):
    encoder = encoders.ColorEncoder()
    store = cache.VectorStore(spark, f"file://{tmp_path}/store")
    key = encoders.model_key("clip-b32", folder)
    encode = lambda rows: encoders.encode_files(rows, encoder).selectExpr("concat(path, channel) id", "vector", "path", "channel", "file_size", "mtime")
    for _ in range(2):
        ingest(spark, folder, store, key, encode, f"file://{tmp_path}/checkpoint", ["png"]).awaitTermination()
    rows = store.read(key).collect()
    assert len(rows) == 5 and len({r.path for r in rows}) == 5
    items = store.read(key).select("path", "channel", "file_size", F.when(F.col("path").contains("near"), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime")).where("path not like '%other%'")
    fresh = []

    def again(missing):
        fresh.extend(r.path for r in missing.collect())
        return missing.selectExpr("path id", "array(1f) vector", "path", "channel", "file_size", "mtime")

    now = store.refresh(items, key, again)
    assert now.count() == 4 and len(set(fresh)) == 1 and store.read(key).count() == 4
    assert store.read("nothing_here").count() == 0


def test_changed_files_take_the_place_of_old_rows(spark, folder, tmp_path):
    encoder = encoders.ColorEncoder()
    store = cache.VectorStore(spark, f"file://{tmp_path}/store")
    encode = lambda rows: encoders.encode_files(rows, encoder).selectExpr("concat(path, channel) id", "vector", "path", "channel", "file_size", "mtime")
    run = lambda n: ingest(spark, folder, store, "k", encode, f"file://{tmp_path}/checkpoint{n}", ["png"]).awaitTermination()
    run(1)
    before = {r.path: r.file_size for r in store.read("k").collect()}
    listed = {r.path for r in scanning.files(spark, folder, ["png"]).collect()}
    assert set(before) == listed
    changed = os.path.join(folder, "other.png")
    with open(changed, "wb") as f:
        f.write(png(np.zeros((9, 9, 4), np.uint8) + 255))
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    run(1)
    assert {r.path: r.file_size for r in store.read("k").collect()} == before
    run(2)
    rows = store.read("k").collect()
    assert len(rows) == len(before) and {r.path: r.file_size for r in rows}[changed] == os.path.getsize(changed)
    assert list(store.parts("k")) == [1]
    # a part whose write hasn't ended doesn't count
    os.makedirs(f"{tmp_path}/store/model_key=k/v9-half")
    assert store.read("k").count() == len(rows)


def test_ranks_in_hot_groups(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 50) END AS g", "id % 7 AS v", "id").repartition(5)
    want = {(r.id, r["rank"], r.members) for r in rank_in_groups(rows, "g", F.desc("v"), F.col("id")).collect()}
    assert {(r.id, r["rank"], r.members) for r in rank_in_groups(rows, "g", F.desc("v"), F.col("id"), most=20).collect()} == want
    assert len(want) == 1000 and max(m for _, _, m in want) == 334


def test_equal_hashes_are_tied_by_stars(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 0 if k % 3 == 0 else int(rng.integers(0, 1 << 62)) if k % 3 == 1 else (1 << int(rng.integers(0, 60))), "RG"[k % 2]) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, h long, channel string").repartition(4)
    for same in ((), ("channel",)):
        edges = hamming_edges(frame, 2, *same)
        assert edges.count() < 300 * 300 / 20
        found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
        ids, h, c = zip(*rows)
        close = np.array([[(bin(a ^ b).count("1") <= 2) and (not same or x == y) for b, y in zip(h, c)] for a, x in zip(h, c)])
        _, label = least_of_components(*[np.concatenate([x, np.arange(300)]) for x in np.nonzero(close)])
        assert all(found.get(i, i) == label[i] for i in ids)


def test_components_of_stars_paths_and_cliques(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1400)] + [(2000 + a, 2000 + b) for a in range(12) for b in range(a)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    found = {r.node: r.component for r in connected_components(frame).collect()}
    assert found == {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1401)} | {2000 + k: 2000 for k in range(12)}


def test_cells_find_nearly_all_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((60, 16))
    v = centre[rng.integers(0, 60, 1500)] + 0.35 * rng.standard_normal((1500, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<float>").repartition(4)
    exact = {(r.a, r.b): r.similarity for r in cosine_pairs(frame, 0.9).collect()}
    for probes, least in ((8, 0.95), (20, 0.99)):
        near = {(r.a, r.b): r.similarity for r in cell_pairs(frame, 0.9, probes).collect()}
        assert set(near) <= set(exact) and len(near) >= least * len(exact) > 1000
        assert all(abs(s - exact[p]) < 1e-9 for p, s in near.items())
    assert cell_pairs(frame.limit(0), 0.9, 8).count() == 0


def test_command_line(spark, folder):
    said: list[str] = []
    assert cli.main(["--scan-exact", folder], spark, said.append) == 0
    assert said[-1] == "1 duplicate groups" and sum("72x72" in x for x in said) == 2
    said.clear()
    assert cli.main(["--scan-qc", folder, "--check-block"], spark, said.append) == 0
    assert any("t.dds" in x and "Block" in x for x in said) and not any("Mipmaps" in x for x in said)
    assert cli.main(["--scan-exact", folder + "/nowhere"], spark, said.append) == 1


def test_levels_of_dds_and_ktx2():
    block = struct.pack("<HHI", 0xF800, 0x001F, 0)
    other = struct.pack("<HHI", 0x001F, 0, 0)
    head = bytearray(dds(8, 8, b"DXT1", payload=block * 4 + other + other + other))
    struct.pack_into("<I", head, 28, 4)
    data = bytes(head)
    assert decoders.decode("a.dds", data).shape == (8, 8, 4) and decoders.decode("a.dds", data, target=4)[0, 0].tolist() == [0, 0, 255, 255]
    assert decoders.decode("a.dds", data, level=2).shape == (2, 2, 4) and decoders.decode("a.dds", data, level=9) is None
    pixels = np.arange(4 * 2 * 4, dtype=np.uint8).tobytes()
    small = bytes([9, 8, 7, 6] * 2)
    import zstandard

    for packed, pack in ((0, bytes), (2, zstandard.compress), (3, zlib.compress)):
        parts = [pack(pixels), pack(small)]
        start = 80 + 48
        index = struct.pack("<3Q", start, len(parts[0]), 32) + struct.pack("<3Q", start + len(parts[0]), len(parts[1]), 8)
        data = b"\xabKTX 20\xbb\r\n\x1a\n" + struct.pack("<9I", 37, 1, 4, 2, 0, 0, 1, 2, packed) + bytes(32) + index + b"".join(parts)
        assert decoders.decode("a.ktx2", data).tobytes() == pixels and decoders.decode("a.ktx2", data, level=1).tolist() == [[[9, 8, 7, 6]] * 2]
        assert decoders.decode("a.ktx2", data[:-3], level=1) is None


def test_jpeg_and_gif_pixels(spark, tmp_path):
    """Written by the JVM, read through its decoder, turned by EXIF."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(24, 16, 1)
    for y in range(16):
        for x in range(24):
            image.setRGB(x, y, 0xFF0000 if x < 12 else 0x0000FF)
    ramp = jvm.java.awt.image.BufferedImage(24, 16, 1)
    for y in range(16):
        for x in range(24):
            ramp.setRGB(x, y, (250 - 10 * x) * 0x010101)
    for name, picture in (("a.jpg", image), ("b.gif", image), ("c.jpg", ramp), ("d.gif", ramp)):
        jvm.javax.imageio.ImageIO.write(picture, name[2:], jvm.java.io.File(f"{tmp_path}/{name}"))
    plain = (tmp_path / "a.jpg").read_bytes()
    exif = b"Exif\0\0MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0) + bytes(4)
    (tmp_path / "turned.jpg").write_bytes(plain[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + plain[2:])
    (tmp_path / "broken.jpg").write_bytes(plain[:30])
    found = scanning.files(spark, str(tmp_path), ["jpg", "gif"], contents=True)
    rows = {os.path.basename(r.path): decoders.decode(r.path, bytes(r.content)) for r in scanning.pictured(found, str(tmp_path)).collect()}
    assert rows["broken.jpg"] is None and rows["turned.jpg"].shape == (24, 16, 4)
    for name in ("a.jpg", "b.gif"):
        assert rows[name].shape == (16, 24, 4) and np.abs(rows[name][3, 3].astype(int) - [255, 0, 0, 255]).max() < 12 and rows[name][3, 20, 2] > 240
    assert rows["turned.jpg"][3, 3, 0] > 240 and rows["turned.jpg"][20, 3, 2] > 240
    result = scan(spark, ScanParams(folder=str(tmp_path), method="perceptual", extensions=("jpg", "gif"), similarity=95.0))
    assert {os.path.basename(r.path) for r in result.groups.collect()} >= {"c.jpg", "d.gif"}
    assert [os.path.basename(r.path) for r in result.undecoded.collect()] == ["broken.jpg"]
    sizes = {os.path.basename(r.path): (r.width, r.height) for r in scanning.metadata(found).collect()}
    assert sizes["a.jpg"] == (24, 16)


def test_encoder_plug_in():
    spec = encoders.MODELS["dinov2"]
    image = np.random.default_rng(0).integers(0, 256, (30, 50, 4)).astype(np.uint8)
    assert encoders.tensor(image, spec).shape == (3, 224, 224)
    model = encoders.OnnxEncoder("nowhere.onnx", encoders.ModelSpec("m", 2, 8, (0,) * 3, (1,) * 3))
    assert np.allclose(model.pick(["last_hidden_state", "x"], [np.array([[[3.0, 4.0], [0, 1]]]), np.zeros((1, 2))]), [[0.6, 0.8]])
    with pytest.raises(ValueError):
        model.pick(["y"], [np.zeros((1, 3))])
    assert np.allclose(encoders.unit(np.zeros(3)), 0)
