"""Sizes, thumbnails, contact sheets, float formats, text encoders, actions and jobs."""

import os
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlode.functions import encoders
from assetlode.operators import actions, pixels, reports
from assetlode.plans import jobs
from assetlode.sources import decoders, thumbnails

RNG = np.random.default_rng(11)


def rows_of(image, img=0):
    h, w = image.shape[:2]
    return [(img, y, x, *map(int, image[y, x])) for y in range(h) for x in range(w)]


def test_sizes_of_rows_and_of_arrays_agree(spark):
    image = RNG.integers(0, 256, (21, 34, 4)).astype(np.uint8)
    px = spark.createDataFrame(rows_of(image), "img long, y long, x long, r long, g long, b long, a long")
    for w, h in ((9, 8), (50, 8), (34, 21), (3, 40)):
        want = decoders.resize(image, w, h)
        got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in pixels.resized(px, F.lit(w), F.lit(h)).collect()}
        assert got == {(y, x): tuple(map(int, want[y, x])) for y in range(h) for x in range(w)}
    assert pixels.dhash_of(px).first().h == decoders.perceptual_hash(image, "Luminance")
    wide = decoders.with_aspect(image, 1.5)
    assert wide.shape == (21, 51, 4) and decoders.with_aspect(image, 1.005) is image
    assert pixels.with_aspect(px, 1.5).count() == 21 * 51 and pixels.with_aspect(px, 1.005) is px
    assert pixels.resized(px.limit(0), F.lit(9), F.lit(8)).count() == 0 and pixels.dhash_of(px.limit(0)).count() == 0


def test_resize_filters():
    image = RNG.integers(0, 256, (40, 60, 4)).astype(np.uint8)
    assert (decoders.resize(image, 20, 40, "nearest") == image[:, 1::3]).all()
    flat = np.full((40, 60, 4), 77, np.uint8)
    assert all((decoders.resize(flat, 13, 90, how) == 77).all() for how in ("nearest", "triangle", "lanczos"))
    assert decoders.fitted(image, 30).shape == (20, 30, 4) and decoders.fitted(image, 60) is image
    assert decoders.fitted(np.zeros((1, 500, 4), np.uint8), 50).shape == (1, 50, 4)
    assert (decoders.png(decoders.png_bytes(image)) == image).all()


def dds10(w, h, code, body):
    head = bytearray(148)
    head[:4], head[84:88] = b"DDS ", b"DX10"
    struct.pack_into("<II", head, 12, h, w)
    struct.pack_into("<I", head, 128, code)
    return bytes(head) + body


def test_float_formats():
    v = np.array([[[0.0, 0.5, 1.0, 1.0], [-1.0, 7.0, np.nan, 0.25]]])
    want = [[0, 127, 255, 255], [0, 255, 0, 63]]
    assert decoders.decode("a.dds", dds10(2, 1, 10, v.astype("<f2").tobytes()))[0].tolist() == want
    assert decoders.decode("a.dds", dds10(2, 1, 2, v.astype("<f4").tobytes()))[0].tolist() == want
    assert decoders.decode("a.dds", dds10(1, 1, 54, np.array([0.5], "<f2").tobytes()))[0].tolist() == [[127, 127, 127, 255]]
    # 0.5 is an exponent of 14 without a fraction; 0.75 has half a fraction more.
    packed = struct.pack("<I", (14 << 6) | (14 << 6 | 32) << 11 | (15 << 5) << 22)
    assert decoders.decode("a.dds", dds10(1, 1, 26, packed))[0].tolist() == [[127, 191, 255, 255]]
    shared = struct.pack("<I", 256 | 128 << 9 | 511 << 18 | 15 << 27)
    assert decoders.decode("a.dds", dds10(1, 1, 67, shared))[0].tolist() == [[127, 63, 254, 255]]
    assert decoders.decode("a.dds", dds10(2, 1, 10, b"")) is None


def test_radiance_lines_plain_and_in_runs():
    head = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 2 +X 8\n"
    pixels_of = RNG.integers(1, 256, (2, 8, 4)).astype(np.uint8)
    pixels_of[:, :, 3] = 130
    pixels_of[1, :, 0] = 9
    plain = head + pixels_of.tobytes()
    runs = head
    for line in pixels_of:
        runs += b"\2\2\0\x08"
        for c in range(4):
            own = line[:, c]
            runs += bytes([128 + 8, own[0]]) if (own == own[0]).all() else bytes([8]) + own.tobytes()
    want = pixels_of[:, :, :3] * 2.0 ** (130 - 136)
    assert np.allclose(decoders.radiance(plain), want) and np.allclose(decoders.radiance(runs), want)
    old = b"#?RADIANCE\n\n-Y 1 +X 5\n" + bytes([10, 20, 30, 130]) + bytes([1, 1, 1, 4])
    assert decoders.radiance(old).shape == (1, 5, 3) and (decoders.radiance(old) == decoders.radiance(old)[0, 0]).all()
    seen = decoders.decode("a.hdr", runs)
    assert seen.shape == (2, 8, 4) and (seen[:, :, 3] == 255).all() and seen[:, :, :3].std() > 0
    assert decoders.decode("a.hdr", runs[:-5]) is None and decoders.decode("a.hdr", b"#?RADIANCE\n") is None
    assert (decoders.exposed(np.zeros((2, 2, 3)))[:, :, :3] == 0).all()


def test_thumbnails_and_sheets(spark, tmp_path):
    images = {f"/t/{k}.png": RNG.integers(0, 256, (100 + 40 * k, 90, 4)).astype(np.uint8) for k in range(3)}
    files = spark.createDataFrame([(p, 10, 5, bytearray(decoders.png_bytes(i))) for p, i in images.items()] + [("/t/bad.png", 1, 1, bytearray(b"x"))], "path string, file_size long, mtime long, content binary")
    made = {r.path: r for r in thumbnails.thumbnails(files, 0).collect()}
    assert set(made) == set(images)
    for path, image in images.items():
        assert (decoders.png(bytes(made[path].png)) == decoders.fitted(image, 64, "nearest")).all()
        assert made[path].key == thumbnails.thumbnail_key(path, 10, 5) != thumbnails.thumbnail_key(path, 10, 6)
    store = thumbnails.thumbnails(files, 0)
    changed = files.withColumn("mtime", F.when(F.col("path") == "/t/1.png", F.lit(6)).otherwise(F.col("mtime")))
    again = {r.path: r.key for r in thumbnails.refreshed(changed, store, 0).collect()}
    assert set(again) == set(images) and {p for p in again if again[p] != made[p].key} == {"/t/1.png"}
    members = spark.createDataFrame([("g", p, 100.0 - k) for k, p in enumerate([*images, "/t/bad.png"])], "group_id string, path string, similarity double")
    layout = reports.contact_sheets(members, columns=2, per_sheet=3)
    sheets = thumbnails.draw_sheets(layout, thumbnails.thumbnails(files, 0), 64)
    paths = thumbnails.write_sheets(sheets, str(tmp_path / "sheets"))
    assert [os.path.basename(p) for p in paths] == ["group_001.png", "group_001_part_2.png"]
    first = decoders.decode(paths[0], open(paths[0], "rb").read())
    assert first.shape == (2 * 80 + 16, 2 * 80 + 16, 4)
    assert tuple(first[14, 14]) == thumbnails.BEST and tuple(first[0, 0]) == thumbnails.BACKGROUND
    last = decoders.decode(paths[1], open(paths[1], "rb").read())
    assert (last[16:80, 16:80] == thumbnails.MISSING).all()
    assert thumbnails.draw_sheets(layout.limit(0), store).count() == 0


def test_text_of_a_model(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"red": 0, "wall": 1, "?": 2}, unk_token="?"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "words.json"))

    class Named:
        def __init__(self, name):
            self.name = name

    class Session:
        def get_inputs(self):
            return [Named("input_ids"), Named("attention_mask")]

        def get_outputs(self):
            return [Named("logits"), Named("text_embeds")]

        def run(self, _, feeds):
            assert feeds["input_ids"].tolist() == [[0, 1, 2]] and feeds["attention_mask"].tolist() == [[1, 1, 1]]
            return [np.zeros((1, 7)), np.array([[3.0, 4.0]])]

    class Model(encoders.OnnxEncoder):
        def open(self, path):
            return Session()

    spec = encoders.ModelSpec("m", 2, 8, (0,) * 3, (1,) * 3)
    assert np.allclose(Model("i.onnx", spec, text_path="t.onnx", tokenizer=str(tmp_path / "words.json")).text("red wall here"), [0.6, 0.8])
    with pytest.raises(ValueError):
        Model("i.onnx", spec).text("red")


def test_weights_are_whole_or_absent(tmp_path):
    source, target = tmp_path / "w.bin", tmp_path / "models" / "w.bin"
    source.write_bytes(bytes(10))
    with pytest.raises(ValueError):
        encoders.install_weights(str(source), str(target), 11)
    assert not target.exists()
    encoders.install_weights(str(source), str(target), 10)
    assert target.read_bytes() == bytes(10) and [p.name for p in target.parent.iterdir()] == ["w.bin"]
    source.write_bytes(bytes(20))
    encoders.install_weights(str(source), str(target), 10)
    assert target.stat().st_size == 10


def test_clones_and_groups(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_bytes(b"same")
    members = spark.createDataFrame([("g", str(tmp_path / n), k + 1, 4) for k, n in enumerate("abc")] + [("h", str(tmp_path / "z"), 1, 4)], "group_id string, path string, rank int, file_size long")
    todo = actions.plan(members, members.where("path like '%/b'"), "reflink")
    done = actions.carry_out(todo, dry_run=False)
    assert [d[2] for d in done] == ["done"] * len(done) and done
    assert (tmp_path / "b").read_bytes() == b"same" and not os.path.samefile(tmp_path / "a", tmp_path / "b")
    assert sorted(os.path.basename(r.path) for r in actions.plan_group(members, "g").collect()) == ["a", "b", "c"]


def test_jobs_can_be_watched_and_cancelled(spark):
    with jobs.cancellable(spark, "short") as name:
        assert spark.range(1000).repartition(3).count() == 1000
        assert jobs.progress(spark, name).jobs >= 1
    assert jobs.progress(spark, "unknown") == jobs.Progress(0, 0, 0, 0) and jobs.progress(spark, "unknown").share == 0

    stop = threading.Event()

    def end():
        while not stop.wait(0.3):
            if jobs.progress(spark, "long").jobs:
                jobs.cancel(spark, "long")

    watcher = threading.Thread(target=end)
    watcher.start()
    try:
        with pytest.raises(Exception, match="(?i)cancel"):
            with jobs.cancellable(spark, "long"):
                spark.range(1 << 44).selectExpr("sum(sqrt(id) * sin(id))").collect()
    finally:
        stop.set()
        watcher.join()
    assert spark.range(5).count() == 5
