"""The result algebra: filter, sort, page, select, and what is shown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlode.functions.predicates import contains_text, is_npot, is_uncompressed, lacks_mips, reaches_similarity
from assetlode.functions.scalars import file_name, format_size, percent

PAGE_LEAST, PAGE_MOST = 100, 5_000

FILTERS = {
    "npot": lambda: is_npot(F.col("width"), F.col("height")),
    "uncompressed": lambda: is_uncompressed(F.col("compression_format")),
    "missing_mips": lambda: lacks_mips(F.col("width"), F.col("height"), F.col("mipmap_count")),
    "cubemap": lambda: F.col("is_cubemap"),
}

#: How a column of the view sorts.
SORTS = {
    "name": lambda: F.lower(file_name(F.col("path"))),
    "path": lambda: F.lower("path"),
    "size": lambda: F.col("file_size"),
    "compression": lambda: F.lower("compression_format"),
    "area": lambda: F.col("width") * F.col("height"),
    "mips": lambda: F.col("mipmap_count"),
    "cubemap": lambda: F.col("is_cubemap"),
}


#: Pages that end within so many rows come from a bounded sort instead of one of all rows.
NEAR_ROWS = 100_000


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with the 1-based place of each row in ``order``, from a range sort instead of one task.

    Ranks are made of ranks within range partitions and of the partitions' sizes,
    a row for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from assetlode.plans.staging import materialize

    laid = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "sorted")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return laid.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn("place", (F.col("__first") + F.col("__inside")).cast("bigint")).drop("__part", "__inside", "__first")


def sorted_view(assets: DataFrame, by: str, descending: bool = False, tie: str = "asset_id") -> DataFrame:
    key = SORTS[by]()
    return positions(assets, key.desc() if descending else key.asc(), F.col(tie).asc())


def page(df: DataFrame, total: int, size: int, wanted: int, *order: Column) -> DataFrame:
    """One page; sizes are clamped to 100..5000 and pages past the end become the last one."""
    size = max(PAGE_LEAST, min(PAGE_MOST, size))
    number = min(wanted, max(1, math.ceil(total / size)) - 1)
    last = (number + 1) * size
    if last <= NEAR_ROWS:
        # The best ``last`` rows of each partition are all that moves.
        placed = df.orderBy(*order).limit(last).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        placed = positions(df, *order)
    return placed.where((F.col("place") > number * size) & (F.col("place") <= last)).withColumn("page", F.lit(number).cast("bigint"))


def filtered_groups(members: DataFrame, query: str = "", least_similarity: float = 0.0, filters: tuple[str, ...] = ()) -> DataFrame:
    """Members that pass all filters, of groups that keep two at least; the best one may be among those that go."""
    keep = reaches_similarity(F.col("is_best"), F.col("similarity"), least_similarity)
    if query:
        keep = keep & contains_text(F.col("path"), query)
    for f in filters:
        keep = keep & FILTERS[f]()
    left = members.where(keep)
    many = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group_id")
    return left.join(many, "group_id", "left_semi")


def sort_groups(members: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Members with the place of their group (by its first row) and their own (the first row stays first)."""
    first = members.where("rank = 1").select("group_id", F.col(by).alias("__head"))
    order = [F.desc("__head") if descending else F.asc("__head"), F.asc("group_id")]
    heads = positions(first, *order).select("group_id", F.col("place").alias("group_place"))
    inner = F.row_number().over(Window.partitionBy("group_id").orderBy(F.col("rank") > 1, F.desc(by) if descending else F.asc(by), "path"))
    return members.withColumn("row_place", inner.cast("bigint")).join(heads, "group_id")


def group_order(members: DataFrame, preset: str) -> DataFrame:
    """group_id, its measure and its place: by count, by total size, or by first path."""
    measure = {"count": F.count(F.lit(1)), "total_size": F.sum("file_size"), "first_path": F.min(F.when(F.col("rank") == 1, F.col("path")))}[preset]
    totals = members.groupBy("group_id").agg(measure.alias("measure"))
    head = F.asc("measure") if preset == "first_path" else F.desc("measure")
    return positions(totals, head, F.asc("group_id"))


# Selections: sets of paths


def select_all(*results: DataFrame) -> DataFrame:
    out = results[0].select("path")
    for r in results[1:]:
        out = out.union(r.select("path"))
    return out.distinct()


def select_none(result: DataFrame) -> DataFrame:
    return result.select("path").limit(0)


def select_except_best(members: DataFrame) -> DataFrame:
    return members.where("rank > 1").select("path").distinct()


def select_invert(everything: DataFrame, checked: DataFrame) -> DataFrame:
    return everything.select("path").subtract(checked.select("path"))


def selected(result: DataFrame, checked: DataFrame) -> DataFrame:
    return result.join(checked.select("path").distinct(), "path", "left_semi")


def link_pairs(members: DataFrame, checked: DataFrame) -> DataFrame:
    """(original, duplicate) for each checked member that is not its group's first row."""
    first = members.where("rank = 1").select("group_id", F.col("path").alias("original"))
    marked = selected(members.select("group_id", "path"), checked).join(first, "group_id")
    return marked.where("path <> original").select("original", F.col("path").alias("duplicate")).distinct()


def without_path(members: DataFrame, path: str) -> DataFrame:
    """Members without one path, however it is written, and without groups that are left with one."""
    left = members.where(F.lower(F.translate("path", "\\", "/")) != path.replace("\\", "/").lower())
    many = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group_id")
    return left.join(many, "group_id", "left_semi")


# Display


def size_text() -> Column:
    return F.concat_ws(" x ", F.col("width").cast("string"), F.col("height").cast("string"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("YES")).otherwise(F.lit("NO"))


def display_rows(members: DataFrame, collapsed: DataFrame, columns: int = 4) -> DataFrame:
    """Header rows of all groups, and detail rows of those that aren't collapsed, with their place in the grid."""
    header = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes")).select(
        "group_id", F.lit(0).cast("bigint").alias("line"), F.lit("header").alias("kind"), F.format_string("%d files", "n").alias("title"), format_size(F.col("bytes")).alias("text"), F.lit(None).cast("bigint").alias("grid"))
    detail = members.join(collapsed.select("group_id"), "group_id", "left_anti").select(
        "group_id", F.col("rank").cast("bigint").alias("line"), F.lit("detail").alias("kind"), file_name(F.col("path")).alias("title"), format_size(F.col("file_size")).alias("text"),
        F.floor((F.col("rank") - 1) / columns).cast("bigint").alias("grid"))
    return header.unionByName(detail)


def spec_matrix(members: DataFrame) -> DataFrame:
    """Each duplicate beside the best of its group, value by value."""
    facts = {
        "name": file_name(F.col("path")), "size": format_size(F.col("file_size")), "resolution": size_text(), "format": F.col("compression_format"),
        "depth": F.format_string("%d-bit", "bit_depth"), "color_space": F.col("color_space"),
        "mips": F.when(F.col("mipmap_count") <= 1, F.lit("No")).otherwise(F.col("mipmap_count").cast("string")), "alpha": F.when(F.col("has_alpha"), F.lit("Yes")).otherwise(F.lit("No")),
    }
    text = members.select("group_id", "rank", percent(F.col("similarity")).alias("similarity"), *[v.alias(k) for k, v in facts.items()])
    long = lambda df: df.select("group_id", "rank", F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).alias("value")) for k in [*facts, "similarity"]])).alias("f")).select("group_id", "rank", "f.fact", "f.value")
    best = long(text.where("rank = 1")).select("group_id", "fact", F.when(F.col("fact") == "similarity", F.lit("-")).otherwise(F.col("value")).alias("original"))
    return long(text.where("rank > 1")).join(best, ["group_id", "fact"]).select("group_id", F.col("rank").cast("bigint").alias("rank"), "fact", "original", F.col("value").alias("duplicate"))


def column_widths(assets: DataFrame, low: int = 8, high: int = 60) -> DataFrame:
    """The longest text of each column of the view, clamped."""
    texts = {"name": file_name(F.col("path")), "path": F.col("path"), "size": format_size(F.col("file_size")), "format": F.col("compression_format"), "resolution": size_text()}
    widest = assets.agg(*[F.max(F.char_length(v)).alias(k) for k, v in texts.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("longest")) for k in texts])).alias("c")
    return widest.select(pairs).select(F.col("c.name").alias("column"), F.greatest(F.lit(low), F.least(F.lit(high), F.col("c.longest"))).cast("bigint").alias("width"))
