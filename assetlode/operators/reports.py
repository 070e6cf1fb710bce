"""Exports and reports: CSV rows, totals, contact-sheet layout, an HTML page."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.functions.scalars import file_name, format_size
from assetlode.operators.views import positions, size_text, yes_no

CSV_COLUMNS = ["File Name", "Format", "Dimensions", "MipMaps", "Cubemap", "Size", "Full Path"]


def csv_rows(assets: DataFrame, issues: DataFrame) -> DataFrame:
    """Assets, then issues with dashes where they have nothing to say, in the seven columns of the export."""
    own = assets.select(
        file_name(F.col("path")).alias("File Name"), F.col("compression_format").alias("Format"), size_text().alias("Dimensions"),
        F.col("mipmap_count").cast("string").alias("MipMaps"), yes_no(F.col("is_cubemap")).alias("Cubemap"), format_size(F.col("file_size")).alias("Size"), F.col("path").alias("Full Path"))
    dash = F.lit("-")
    found = issues.select(
        file_name(F.col("path")).alias("File Name"), F.concat(F.lit("QC Issue: "), "issue").alias("Format"), dash.alias("Dimensions"),
        dash.alias("MipMaps"), dash.alias("Cubemap"), dash.alias("Size"), F.col("path").alias("Full Path"))
    return own.unionByName(found)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def summary(members: DataFrame, issues: DataFrame, inventory: DataFrame) -> DataFrame:
    """Groups, processed rows (of the first kind of result that there is), and bytes that copies waste."""
    g = members.agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("n_members"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("file_size"))), F.lit(0)).alias("wasted_bytes"))
    i, v = issues.agg(F.count(F.lit(1)).alias("n_issues")), inventory.agg(F.count(F.lit(1)).alias("n_inventory"))
    # Three single rows.
    joined = g.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(v))
    processed = F.when(F.col("n_members") > 0, F.col("n_members")).when(F.col("n_issues") > 0, F.col("n_issues")).otherwise(F.col("n_inventory"))
    return joined.select("groups", processed.alias("processed"), F.col("wasted_bytes").cast("bigint").alias("wasted_bytes"), format_size(F.col("wasted_bytes")).alias("wasted"))


def contact_sheets(members: DataFrame, most_groups: int = 50, per_group: int = 200, per_sheet: int = 50, columns: int = 5) -> DataFrame:
    """Where each picture goes: group, sheet, row, column; the largest groups and their most similar pictures."""
    from pyspark.sql import Window

    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = positions(sizes, F.desc("n"), F.asc("group_id")).where(F.col("place") <= most_groups).select("group_id", F.col("place").alias("group_place"))
    index = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("similarity"), "path")) - 1
    laid = members.join(chosen, "group_id").withColumn("i", index).where(F.col("i") < per_group)
    on_sheet = F.col("i") % per_sheet
    name = F.when(F.col("i") < per_sheet, F.format_string("group_%03d.png", "group_place")).otherwise(F.format_string("group_%03d_part_%d.png", F.col("group_place"), F.floor(F.col("i") / per_sheet) + 1))
    return laid.select("group_id", "path", name.alias("sheet"), F.floor(on_sheet / columns).cast("bigint").alias("row"), (on_sheet % columns).cast("bigint").alias("col"),
                       F.when(F.col("similarity") >= 99.9, F.lit("[BEST REPRESENTATION]")).otherwise(F.lit("")).alias("mark"))


def html_report(members: DataFrame, issues: DataFrame, inventory: DataFrame, path: str | Path, most_groups: int = 100, per_group: int = 20) -> None:
    """A page with the totals and the first groups; what reaches the driver is bounded by the two limits."""
    from pyspark.sql import Window

    total = summary(members, issues, inventory).first()
    wanted = positions(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), F.asc("group_id")).where(F.col("place") <= most_groups)
    shown = members.join(wanted, "group_id").withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("rank"))).where(F.col("k") <= per_group)
    rows = shown.select("place", "k", "path", format_size(F.col("file_size")).alias("size"), "similarity").orderBy("place", "k").collect()
    body = [f"<h1>Asset report</h1><p>{total['groups']} groups, {total['processed']} rows, {html.escape(total['wasted'])} wasted</p>"]
    place = None
    for r in rows:
        if r["place"] != place:
            body.append(("</ul>" if place else "") + f"<h2>Group {r['place']}</h2><ul>")
            place = r["place"]
        body.append(f"<li>{html.escape(r['path'])} ({r['size']}, {r['similarity']:.1f}%)</li>")
    Path(path).write_text("<!DOCTYPE html><meta charset=utf-8>" + "\n".join(body) + ("</ul>" if place else ""), encoding="utf-8")
