"""Row predicates over assets, groups and issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlode.functions.scalars import file_name, parent

# What marks a data map in a path.
DATA_TAGS = "_norm _normal _ddn _nrm _rough _roughness _rgh _metal _metallic _met _mask _msk _ao _orm _mra _disp".split()


def tags_of(text: str) -> list[str]:
    """A comma-separated list, trimmed and without empty entries."""
    return [t.strip() for t in text.split(",") if t.strip()]


def not_power_of_two(n: Column) -> Column:
    return (n <= 0) | (n.bitwiseAND(n - 1) != 0)


def is_npot(width: Column, height: Column) -> Column:
    return not_power_of_two(width) | not_power_of_two(height)


def is_uncompressed(compression: Column) -> Column:
    return F.lower(compression).contains("uncompressed")


def lacks_mips(width: Column, height: Column, mips: Column) -> Column:
    return (mips <= 1) & (width >= 64) & (height >= 64)


def contains_text(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.lower())


def name_contains(path: Column, query: str) -> Column:
    return contains_text(file_name(path), query)


def reaches_similarity(is_best: Column, similarity: Column, least: float) -> Column:
    return is_best | (similarity >= least)


def has_tag(path: Column, tags: list[str]) -> Column:
    """True if any tag is in the path, or if there are no tags."""
    if not tags:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(t.lower()) for t in tags]), lambda t: F.contains(F.lower(path), t))


def has_extension(path: Column, extensions: list[str]) -> Column:
    """The extension is one of ``extensions`` in any case; files without one never match."""
    own = F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))
    return own.isin([e.lower().lstrip(".") for e in extensions])


def in_excluded_folder(path: Column, excluded: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(parent(path)), "/"), F.array(*[F.lit(e.lower()) for e in excluded])) if excluded else F.lit(False)
