"""Small pictures of files, and contact sheets drawn from them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.plans.shipping import ship
from assetlode.sources.decoders import decode, fitted, png, png_bytes

#: Side and filter of each quality.
QUALITIES = ((64, "nearest"), (128, "triangle"), (256, "lanczos"))
GAP, BACKGROUND, MISSING, BEST = 16, (45, 45, 45, 255), (60, 60, 60, 255), (240, 177, 50, 255)


def thumbnail_key(path: str, size: int, mtime: int) -> str:
    """A name that changes with the file: XXH64 of its path, size and modification time in nanoseconds."""
    import xxhash

    return xxhash.xxh64_hexdigest(path.encode() + struct.pack("<Q", size) + (mtime * 10**9).to_bytes(16, "little"))


def thumbnails(found: DataFrame, quality: int = 1) -> DataFrame:
    """path, key and PNG bytes of (path, file_size, mtime, content) for the files that can be decoded."""
    side, how = QUALITIES[min(max(quality, 0), len(QUALITIES) - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, size, mtime, content in zip(pdf["path"], pdf["file_size"], pdf["mtime"], pdf["content"]):
                image = decode(path, bytes(content), side)
                if image is not None:
                    out.append((path, thumbnail_key(path, int(size), int(mtime)), png_bytes(fitted(image, side, how))))
            yield pd.DataFrame(out, columns=["path", "key", "png"])

    ship(found.sparkSession)
    return found.select("path", "file_size", "mtime", "content").mapInPandas(run, "path string, key string, png binary")


def refreshed(found: DataFrame, store: DataFrame, quality: int = 1) -> DataFrame:
    """The thumbnails of ``found``: those of ``store`` whose key still holds, and new ones of all other files."""

    @F.pandas_udf("string")
    def key(path: pd.Series, size: pd.Series, mtime: pd.Series) -> pd.Series:
        return pd.Series([thumbnail_key(p, int(s), int(m)) for p, s, m in zip(path, size, mtime)])

    ship(found.sparkSession)
    keyed = found.withColumn("key", key("path", "file_size", "mtime"))
    known = store.select("path", "key", "png").dropDuplicates(["key"])
    fresh = thumbnails(keyed.join(known.select("key"), "key", "left_anti"), quality)
    return keyed.select("path", "key").join(known.select("key", "png"), "key").select("path", "key", "png").unionByName(fresh)


def draw_sheets(layout: DataFrame, small: DataFrame, side: int = 128) -> DataFrame:
    """sheet and PNG bytes for each sheet of ``reports.contact_sheets``, whose pictures are those of (path, png).

    A sheet holds as many pictures as the layout lets, so a task draws a bounded
    number. Pictures marked best have a coloured frame; files without a picture are
    plain cells. Names are in the layout and are not drawn.
    """

    def draw(cells: pd.DataFrame) -> pd.DataFrame:
        step = side + GAP
        canvas = np.full((int(cells["row"].max() + 1) * step + GAP, int(cells["col"].max() + 1) * step + GAP, 4), BACKGROUND, dtype=np.uint8)
        for row, col, mark, body in zip(cells["row"], cells["col"], cells["mark"], cells["png"]):
            y, x = int(row) * step + GAP, int(col) * step + GAP
            if mark:
                canvas[y - 4 : y + side + 4, x - 4 : x + side + 4] = BEST
            canvas[y : y + side, x : x + side] = MISSING
            image = None if body is None else png(bytes(body))
            if image is not None:
                image = fitted(image, side)
                h, w = image.shape[:2]
                y, x = y + (side - h) // 2, x + (side - w) // 2
                alpha = image[:, :, 3:].astype(np.float64) / 255
                under = canvas[y : y + h, x : x + w, :3]
                canvas[y : y + h, x : x + w, :3] = np.floor(image[:, :, :3] * alpha + under * (1 - alpha) + 0.5)
        return pd.DataFrame({"sheet": [cells["sheet"].iloc[0]], "png": [png_bytes(canvas)]})

    ship(layout.sparkSession)
    cells = layout.join(small.select("path", "png").dropDuplicates(["path"]), "path", "left")
    return cells.select("sheet", F.col("row"), "col", "mark", "png").groupBy("sheet").applyInPandas(draw, "sheet string, png binary")


def write_sheets(sheets: DataFrame, folder: str) -> list[str]:
    """The sheets as files of a local folder, one after the other; their paths."""
    import os

    os.makedirs(folder, exist_ok=True)
    paths = []
    for sheet in sheets.toLocalIterator():
        path = os.path.join(folder, sheet["sheet"])
        with open(path, "wb") as out:
            out.write(bytes(sheet["png"]))
        paths.append(path)
    return sorted(paths)
