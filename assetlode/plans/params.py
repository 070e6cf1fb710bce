"""Scan parameters, and one entry point for every kind of scan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.functions.predicates import tags_of
from assetlode.functions.scalars import LOADERS, max_distance
from assetlode.operators import dups, qc
from assetlode.plans.staging import materialize
from assetlode.sources import scan as scanning

METHODS = ("exact", "perceptual", "ai", "inventory", "qc")
#: Probes and refinement of the approximate search presets; similarities are exact, so nothing is left to refine.
PRECISION = ((8, 1), (20, 3), (80, 8), (256, 20))
INDEXED_FROM = 5_000
SORT_COLUMNS = {"File Name": "name", "Path": "path", "Size": "size", "Format": "compression", "Dimensions": "area", "MipMaps": "mips", "Cubemap": "cubemap"}


@dataclass(frozen=True)
class QcParams:
    npot: bool = True
    mipmaps: bool = True
    block_align: bool = True
    bit_depth: bool = True
    color_space: bool = True
    data_tags: str = ""
    max_resolution: int = 4096
    match_by_stem: bool = True
    hide_same_resolution: bool = False  # accepted, and without effect
    compat_swapped_flags: bool = False


@dataclass(frozen=True)
class ScanParams:
    folder: str
    method: str = "exact"
    folder_b: str = ""
    extensions: tuple[str, ...] = tuple(sorted(e for es in LOADERS.values() for e in es))
    excluded: str = ".git, .svn, cache, temp"
    similarity: float = 90.0
    batch_size: int = 128
    channels: str = ""
    channel_tags: str = ""
    luminance: bool = False
    ignore_solid: bool = False
    same_channel_only: bool = False
    query: str = ""
    precision: int = 1
    max_neighbors: int | None = None
    qc: QcParams = field(default_factory=QcParams)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> ScanParams:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        raw["qc"], raw["extensions"] = QcParams(**raw.get("qc", {})), tuple(raw["extensions"])
        return cls(**raw)


@dataclass
class ScanResult:
    groups: DataFrame | None = None
    issues: DataFrame | None = None
    inventory: DataFrame | None = None
    undecoded: DataFrame | None = None


def expand(files: DataFrame, p: ScanParams) -> DataFrame:
    from assetlode.catalog import analysis_items

    items = analysis_items(files, p.channel_tags, p.channels, p.luminance)
    return files.join(items, "path")


def scan(spark: SparkSession, p: ScanParams, encoder=None) -> ScanResult:
    """Run one scan; its kind decides which parts of the result there are."""
    if p.method not in METHODS:
        raise ValueError(f"unknown method {p.method!r}")
    read = lambda root: scanning.files(spark, root, list(p.extensions), tags_of(p.excluded), contents=True)
    found = read(p.folder)
    if p.method == "inventory":
        return ScanResult(inventory=scanning.metadata(found).withColumn("similarity", F.lit(0.0)))
    if p.method == "qc":
        if p.folder_b:
            sides = [scanning.metadata(read(f)) for f in (p.folder, p.folder_b)]
            return ScanResult(issues=qc.compare_folders(*sides, by_stem=p.qc.match_by_stem))
        q = p.qc
        issues = qc.audit(scanning.metadata(found), q.max_resolution, tags_of(q.data_tags) or None, q.compat_swapped_flags, q.mipmaps, q.block_align, q.npot, q.bit_depth)
        return ScanResult(issues=issues if q.color_space else issues.where("issue <> 'Color Space Misconfiguration'"))
    if p.method == "exact":
        # Only files whose size occurs twice are read.
        real = found.where("file_size > 0")
        twins = real.groupBy("file_size").count().where("count > 1").select("file_size")
        return ScanResult(groups=dups.exact_groups(scanning.content_hashes(real.join(twins, "file_size", "left_semi"))))
    pictures = scanning.pictured(found, p.folder)
    shape = scanning.metadata(found).select("path", "width", "height", "file_size")
    if p.method == "perceptual":
        hashed = scanning.fingerprints(expand(pictures, p), 5 if p.ignore_solid else None)
        rows = hashed.withColumn("id", F.xxhash64("path", "channel")).join(shape, "path")
        return ScanResult(groups=dups.perceptual_groups(rows, max_distance(p.similarity), p.same_channel_only), undecoded=scanning.undecoded(pictures))
    from assetlode.functions.encoders import ColorEncoder, encode_files

    encoder = encoder or ColorEncoder()
    vectors = encode_files(expand(pictures, p), encoder, p.batch_size).withColumn("id", F.xxhash64("path", "channel")).withColumnRenamed("vector", "v")
    if p.query:
        return ScanResult(groups=dups.search(vectors, encoder.text(p.query).tolist()), undecoded=scanning.undecoded(pictures))
    vectors = materialize(vectors.drop("file_size").join(shape, "path"), "vectors")
    # Below INDEXED_FROM rows all pairs are compared, beyond it those that meet in a cell.
    probes = PRECISION[p.precision][0] if vectors.count() >= INDEXED_FROM else None
    groups = dups.semantic_groups(vectors, p.similarity / 100, p.max_neighbors, probes)
    best = groups.where("is_best").select("component", scanning.record_id(F.col("path"), F.lit("")).alias("group_id"))
    return ScanResult(groups=groups.join(best, "component"), undecoded=scanning.undecoded(pictures))
