"""Reading real files: listing, metadata, rasters and fingerprints as DataFrames."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.functions.predicates import has_extension, in_excluded_folder
from assetlode.functions.scalars import decode_uri, extension, file_name
from assetlode.plans.shipping import ship
from assetlode.sources.decoders import decode, perceptual_hash
from assetlode.sources.headers import SCHEMA, probe

#: How much of a file its header can need, by extension; others go whole to the parser.
HEAD_BYTES = (
    dict.fromkeys("dds astc atc pvr psd qoi crn bmp tga gif".split(), 4 << 10) | dict.fromkeys("ktx2 basis heic heif hdr webp".split(), 64 << 10)
    | dict.fromkeys("png jpg jpeg exr".split(), 1 << 20)
)
#: The smallest level of a picture with mipmaps that fingerprints are taken from has at least so many pixels a side.
PREVIEW = 256
#: Formats that the JVM decodes.
JVM_PICTURES = ("jpg", "jpeg", "gif")


def plain_path(path: F.Column) -> F.Column:
    """A path as the file system has it, of the URI that Spark's listing gives."""
    return decode_uri(F.regexp_replace(path, "^file:/+", "/"))


def check_root(root: str) -> str:
    """A local root must be a folder; other file systems are asked by Spark."""
    if "://" not in root and not os.path.isdir(root):
        raise NotADirectoryError(root)
    return root


def files(spark: SparkSession, root: str, extensions: list[str], excluded: list[str] = (), contents: bool = False) -> DataFrame:
    """path, file_size and mtime of the files under ``root``, and their content if asked.

    Without ``contents`` no file is opened: the columns come from the listing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(check_root(root))
    own = raw.select(plain_path(F.col("path")).alias("path"), F.coalesce("length", F.lit(0)).alias("file_size"),
                     F.unix_seconds("modificationTime").alias("mtime"), *(["content"] if contents else []))
    return own.where(has_extension(F.col("path"), list(extensions)) & ~in_excluded_folder(F.col("path"), list(excluded)))


def warnings(spark: SparkSession, root: str) -> DataFrame:
    """What cannot be read under a local root, one message each; the scan itself goes on without it."""
    found: list[tuple[str, str]] = []
    for folder, _, names in os.walk(check_root(root), onerror=lambda e: found.append((str(e.filename), e.strerror or "error"))):
        for n in names:
            path = os.path.join(folder, n)
            try:
                mode = os.stat(path).st_mode
                if stat.S_ISREG(mode) and not os.access(path, os.R_OK):
                    found.append((path, "Permission denied"))
            except OSError as e:
                found.append((path, e.strerror or "error"))
    return spark.createDataFrame(found, "path string, warning string")


def metadata(found: DataFrame) -> DataFrame:
    """The metadata of files with ``content``; a file that cannot be parsed keeps the fallback row and an ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [probe(p, bytes(c), n) for p, c, n in zip(pdf["path"], pdf["content"], pdf["file_size"])]
            yield pd.DataFrame({"path": pdf["path"], "mtime": pdf["mtime"]}).join(pd.DataFrame(rows, index=pdf.index))

    ship(found.sparkSession)
    # Only the head of a file leaves the JVM where the header is there.
    bound = F.create_map(*[F.lit(x) for pair in HEAD_BYTES.items() for x in pair])
    most = F.coalesce(F.try_element_at(bound, extension(file_name(F.col("path")))), F.lit((1 << 31) - 1))
    heads = found.select("path", "file_size", "mtime", F.substring(F.col("content"), F.lit(1), most).alias("content"))
    return heads.mapInPandas(run, f"path string, mtime bigint, {SCHEMA}")


def pictured(found: DataFrame, root: str) -> DataFrame:
    """``found`` with the content of JPEG and GIF files replaced by their pixels, which the JVM decodes, and the head of the file.

    Files that it can't decode stay as they are.
    """
    spark = found.sparkSession
    names = "*.{" + ",".join(x for e in JVM_PICTURES for x in (e, e.upper())) + "}"
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).load(check_root(root))
    four = lambda c: F.unhex(F.lpad(F.hex(F.col(f"image.{c}")), 8, "0"))
    pixels = images.select(plain_path(F.col("image.origin")).alias("path"), F.concat(F.lit(b"JIMG"), four("width"), four("height"), four("nChannels"), "image.data").alias("pixels"))
    own = found.where(has_extension(F.col("path"), list(JVM_PICTURES))).join(pixels, "path", "left")
    head = F.substring(F.col("content"), F.lit(1), F.lit(64 << 10))
    own = own.withColumn("content", F.when(F.col("pixels").isNotNull(), F.concat("pixels", head)).otherwise(F.col("content"))).drop("pixels")
    return found.where(~has_extension(F.col("path"), list(JVM_PICTURES))).unionByName(own)


def content_hashes(found: DataFrame) -> DataFrame:
    """path, file_size and the XXH64 of the content as unpadded hexadecimal digits."""

    @F.pandas_udf("string")
    def xxh64(contents: pd.Series) -> pd.Series:
        import xxhash

        return contents.map(lambda c: format(xxhash.xxh64_intdigest(bytes(c)), "x"))

    return found.select("path", "file_size", xxh64("content").alias("content_hash"))


def record_id(path, channel) -> F.Column:
    """XXH64 of path and channel, 16 digits."""

    @F.pandas_udf("string")
    def xxh64(a: pd.Series, b: pd.Series) -> pd.Series:
        import xxhash

        return (a + b).map(lambda s: format(xxhash.xxh64_intdigest(s), "016x"))

    return xxh64(path, channel)


def fingerprints(found: DataFrame, least_range: int | None = None) -> DataFrame:
    """path, channel and h of (path, channel, content) whose raster can be decoded and isn't flat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, own, content in zip(pdf["path"], pdf["channel"], pdf["content"]):
                image = decode(path, bytes(content), PREVIEW)
                h = None if image is None else perceptual_hash(image, own, least_range)
                if h is not None:
                    out.append((path, own, h))
            yield pd.DataFrame(out, columns=["path", "channel", "h"])

    ship(found.sparkSession)
    return found.select("path", "channel", "content").mapInPandas(run, "path string, channel string, h bigint")


def undecoded(found: DataFrame) -> DataFrame:
    """path and reason of the files with ``content`` that give no raster, so no fingerprint or vector either."""

    @F.pandas_udf("string")
    def reason(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([None if decode(p, bytes(c), 9) is not None else "no decoder for the pixels, or a damaged file" for p, c in zip(paths, contents)], dtype=object)

    ship(found.sparkSession)
    return found.select("path", reason("path", "content").alias("reason")).where("reason is not null")


def rasters(found: DataFrame) -> DataFrame:
    """Exploded pixels (img, y, x, r, g, b, a) of the files that can be decoded; img is the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                image = decode(path, bytes(content))
                if image is not None:
                    y, x = np.indices(image.shape[:2])
                    flat = image.reshape(-1, 4).astype("int64")
                    yield pd.DataFrame({"img": path, "y": y.ravel(), "x": x.ravel(), **{c: flat[:, k] for k, c in enumerate("rgba")}})

    ship(found.sparkSession)
    return found.select("path", "content").mapInPandas(run, "img string, y bigint, x bigint, r bigint, g bigint, b bigint, a bigint")
