"""Every query of the engine by name, with the SQL that states the same result.

A query takes (spark, sf_dir). The relations it reads are those of
``sources.fixtures``; the operators are the library's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlode.functions import predicates as P
from assetlode.functions import scalars as S
from assetlode.operators import cache, dups, pairs, pixels, qc, reports, tonemap, views
from assetlode.operators.components import connected_components
from assetlode.plans.shipping import ship
from assetlode.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

COSINE, HAMMING = 0.40, 16


def query(sql: str | None = None, *relations: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        _QUERIES[key] = lambda spark, sf_dir: fn(ship(spark), sf_dir)
        if sql:
            _ORACLES[key] = X.oracle(sql, *relations)
        return fn

    return register


def on_assets(name: str, sql: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    query(sql, "assets", name=name)(lambda s, d: fn(X.assets(s, d)))


def on_px(name: str, sql: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    query(sql, "px", name=name)(lambda s, d: fn(X.px(s, d)))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _log_size(n: str) -> str:
    cases = " ".join(f"WHEN {n} >= {1024**k} THEN printf('%.2f {u}', {n} / {1024.0**k:.1f})" for k, u in reversed(list(enumerate(S.UNITS))) if k < 5)
    return f"CASE WHEN {n} = 0 THEN '0 B' {cases} END"


NAME = "regexp_extract(path, '[^/]*$')"
STEM = f"regexp_extract({NAME}, '^(.+?)(\\.[^.]*)?$', 1)"

# Sources

SCAN_EXTENSIONS, EXCLUDED = ["png", "tga", ".DDS"], ".git, .svn, cache, temp"

on_assets("scan_ext_filter", f"SELECT asset_id, path FROM assets WHERE lower(regexp_extract({NAME}, '^.+\\.([^.]+)$', 1)) IN ('png', 'tga', 'dds')",
          lambda a: a.where(P.has_extension(F.col("path"), SCAN_EXTENSIONS)).select("asset_id", "path"))
on_assets("scan_exclude", "SELECT asset_id, path FROM assets WHERE NOT list_has_any(string_split(lower(regexp_replace(path, '/[^/]*$', '')), '/'), ['.git', '.svn', 'cache', 'temp'])",
          lambda a: a.where(~P.in_excluded_folder(F.col("path"), P.tags_of(EXCLUDED))).select("asset_id", "path"))
on_assets("file_stat", "SELECT asset_id, path, coalesce(file_size, 0) AS file_size, coalesce(mtime, 0) AS mtime FROM assets",
          lambda a: a.select("asset_id", "path", F.coalesce("file_size", F.lit(0)).alias("file_size"), F.coalesce("mtime", F.lit(0)).alias("mtime")))


@query("SELECT vec_id, label, len(embedding) AS dims, embedding FROM embeddings")
def vector_scan(s, d):
    return X.table(s, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"), "embedding")


_LOADER_CASE = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in xs)}) THEN '{n}'" for n, xs in S.LOADERS.items())
on_assets("loader_dispatch", f"SELECT asset_id, CASE {_LOADER_CASE} END AS loader FROM (SELECT asset_id, lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1)) AS e FROM assets) t",
          lambda a: a.select("asset_id", S.loader_of(S.extension(S.file_name(F.col("path")))).alias("loader")))


@query("SELECT page_id, url_decode(regexp_replace(concat('file://', replace(url, '/', '%2F'), '+x%20y'), '^file://', '')) AS path FROM pages")
def decode_url(s, d):
    raw = F.concat(F.lit("file://"), F.replace(F.col("url"), F.lit("/"), F.lit("%2F")), F.lit("+x%20y"))
    return X.table(s, d, "pages").select("page_id", S.decode_uri(raw).alias("path"))


_DXGI_CASE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.DXGI_NAMES.items())
on_assets("dxgi_name", f"SELECT asset_id, CASE asset_id % 120 {_DXGI_CASE} ELSE printf('DX10 (DXGI %d)', asset_id % 120) END AS format FROM assets",
          lambda a: a.select("asset_id", S.dxgi_name(F.col("asset_id") % 120).alias("format")))


_ATC = """
WITH n AS (SELECT asset_id, CASE asset_id % 5 WHEN 0 THEN k*k WHEN 1 THEN k*k//2 WHEN 2 THEN 2*k*k WHEN 3 THEN k*k + 7 ELSE k*k END AS len
  FROM (SELECT asset_id, 4 * (asset_id % 200) AS k FROM assets) t),
s AS (SELECT *, CAST(floor(sqrt(len)) AS BIGINT) AS s1, CAST(floor(sqrt(len*2)) AS BIGINT) AS s2, CAST(floor(sqrt(len//2)) AS BIGINT) AS s3 FROM n),
p AS (SELECT *, CASE WHEN s1 > 0 AND s1 % 4 = 0 AND s1*s1 = len THEN 1 WHEN s2 > 0 AND s2 % 4 = 0 AND s2*s2 = 2*len THEN 2
   WHEN s3 > 0 AND s3 % 4 = 0 AND 2*s3*s3 = len THEN 3 WHEN s1 > 0 AND s1 % 4 = 0 AND 2*s1*s1 = 2*len THEN 4 END AS k FROM s)
SELECT asset_id, CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN 2*s3 WHEN 4 THEN 2*s1 END AS width,
  CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s1 END AS height FROM p
"""


def _atc(a: DataFrame) -> DataFrame:
    k = 4 * (F.col("asset_id") % 200)
    length = F.expr("CASE asset_id % 5 WHEN 0 THEN k*k WHEN 1 THEN k*k div 2 WHEN 2 THEN 2*k*k WHEN 3 THEN k*k + 7 ELSE k*k END")
    dims = S.atc_dims(F.col("len"))
    return a.withColumn("k", k).withColumn("len", length).select("asset_id", dims.getField("width").alias("width"), dims.getField("height").alias("height"))


on_assets("atc_infer_dims", _ATC, _atc)

_FALLBACK = "asset_id % 4 = 0"
on_assets("metadata_fallback", f"""
SELECT asset_id, CASE WHEN {_FALLBACK} THEN 0 ELSE width END AS width, CASE WHEN {_FALLBACK} THEN lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1)) ELSE compression_format END AS format,
  CASE WHEN {_FALLBACK} THEN 'sRGB' ELSE color_space END AS color_space, CASE WHEN {_FALLBACK} THEN false ELSE has_alpha END AS has_alpha,
  CASE WHEN {_FALLBACK} THEN 8 ELSE bit_depth END AS bit_depth, CASE WHEN {_FALLBACK} THEN 1 ELSE mipmap_count END AS mipmap_count FROM assets
""", lambda a: a.select("asset_id", *[F.coalesce(F.when(~F.expr(_FALLBACK), F.col(c)), default).alias(n) for c, n, default in (
    ("width", "width", F.lit(0)), ("compression_format", "format", S.extension(S.file_name(F.col("path")))), ("color_space", "color_space", F.lit("sRGB")),
    ("has_alpha", "has_alpha", F.lit(False)), ("bit_depth", "bit_depth", F.lit(8)), ("mipmap_count", "mipmap_count", F.lit(1)))]))

on_assets("mip_select", """
SELECT asset_id, CAST(coalesce(list_max(list_filter(range(0, greatest(mipmap_count, 1)), lambda i: floor(width / pow(2, i)) >= 128 AND floor(height / pow(2, i)) >= 128)), 0) AS BIGINT) AS level FROM assets
""", lambda a: a.select("asset_id", S.mip_for_target(F.col("width"), F.col("height"), F.col("mipmap_count"), 128).alias("level")))


def _up(side: str, block: int) -> str:
    return f"(({side} + {block - 1}) // {block})"


def _ktx2_sql() -> str:
    cases = [f"WHEN f IN ({', '.join(map(str, c))}) THEN width*height*{n}" for n, c in S.PIXEL_BYTES.items()]
    for codes, bx, by, n in ((S.BLOCKS_8, 4, 4, 8), (S.BLOCKS_16, 4, 4, 16), (S.BLOCKS_WIDE, 8, 4, 8)):
        cases.append(f"WHEN f IN ({', '.join(map(str, codes))}) THEN {_up('width', bx)}*{_up('height', by)}*{n}")
    for k, (bx, by) in enumerate(S.ASTC_SHAPES):
        cases.append(f"WHEN f IN ({157 + 2 * k}, {158 + 2 * k}, {1000066000 + k}) THEN {_up('width', bx)}*{_up('height', by)}*16")
    return f"SELECT asset_id, f AS vk_format, CASE {' '.join(cases)} END AS bytes FROM (SELECT asset_id, width, height, CASE WHEN asset_id % 5 = 0 THEN 1000054000 + asset_id % 9 WHEN asset_id % 7 = 0 THEN 1000066000 + asset_id % 15 ELSE asset_id % 190 END AS f FROM assets) t"


on_assets("ktx2_slice_bytes", _ktx2_sql(), lambda a: a.withColumn(
    "f", F.expr("CASE WHEN asset_id % 5 = 0 THEN 1000054000 + asset_id % 9 WHEN asset_id % 7 = 0 THEN 1000066000 + asset_id % 15 ELSE asset_id % 190 END")).select(
    "asset_id", F.col("f").alias("vk_format"), S.slice_bytes(F.col("f"), F.col("width"), F.col("height")).alias("bytes")))

# Projections and predicates

_INVENTORY = ["asset_id", "path", "file_size", "width", "height", "compression_format", "color_space", "has_alpha", "bit_depth", "mipmap_count", "is_cubemap"]
on_assets("inventory", f"SELECT {', '.join(_INVENTORY)}, CAST(0 AS DOUBLE) AS similarity FROM assets", lambda a: a.select(*_INVENTORY, F.lit(0.0).alias("similarity")))
_NPOT = "(width <= 0 OR (width & (width - 1)) <> 0 OR height <= 0 OR (height & (height - 1)) <> 0)"
on_assets("filter_npot", f"SELECT asset_id, width, height FROM assets WHERE {_NPOT}", lambda a: a.where(views.FILTERS["npot"]()).select("asset_id", "width", "height"))
on_assets("filter_uncompressed", "SELECT asset_id FROM assets WHERE contains(lower(compression_format), 'uncompressed')", lambda a: a.where(views.FILTERS["uncompressed"]()).select("asset_id"))
on_assets("filter_missing_mips", "SELECT asset_id FROM assets WHERE mipmap_count <= 1 AND width >= 64 AND height >= 64", lambda a: a.where(views.FILTERS["missing_mips"]()).select("asset_id"))
on_assets("filter_cubemap", "SELECT asset_id FROM assets WHERE is_cubemap", lambda a: a.where(views.FILTERS["cubemap"]()).select("asset_id"))
on_assets("search_filename", f"SELECT asset_id, path FROM assets WHERE contains(lower({NAME}), 'red')", lambda a: a.where(P.name_contains(F.col("path"), "RED")).select("asset_id", "path"))
on_assets("search_path", "SELECT asset_id, path FROM assets WHERE contains(lower(path), 'cache/')", lambda a: a.where(P.contains_text(F.col("path"), "Cache/")).select("asset_id", "path"))
on_assets("tag_match", "SELECT asset_id, contains(lower(path), '_norm') OR contains(lower(path), 'promo') AS matches FROM assets",
          lambda a: a.select("asset_id", P.has_tag(F.col("path"), P.tags_of("_norm, , PROMO")).alias("matches")))

# Groups of assets: those that share size and format, ranked; their similarity comes from the rank

_GROUPS = """
WITH ranked AS (SELECT a.*, concat(width, 'x', height, '/', compression_format) AS group_id,
  row_number() OVER (PARTITION BY width, height, compression_format ORDER BY file_size DESC, path) AS rank,
  count(*) OVER (PARTITION BY width, height, compression_format) AS n FROM assets a),
groups AS (SELECT *, rank = 1 AS is_best, CASE WHEN rank = 1 THEN 100.0::DOUBLE ELSE (100 - asset_id % 40)::DOUBLE END AS similarity FROM ranked WHERE n > 1)
"""


def asset_groups(a: DataFrame) -> DataFrame:
    own = Window.partitionBy("width", "height", "compression_format")
    ranked = a.withColumns({
        "group_id": F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("/"), "compression_format"),
        "rank": F.row_number().over(own.orderBy(F.desc("file_size"), "path")), "n": F.count(F.lit(1)).over(own)})
    similarity = F.when(F.col("rank") == 1, F.lit(100.0)).otherwise((100 - F.col("asset_id") % 40).cast("double"))
    return ranked.where("n > 1").drop("n").withColumns({"is_best": F.col("rank") == 1, "similarity": similarity})


def on_groups(name: str, sql: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    on_assets(name, _GROUPS + sql, lambda a: fn(asset_groups(a)))


on_groups("rank_best", "SELECT group_id, rank, is_best, path FROM groups", lambda g: g.select("group_id", F.col("rank").cast("bigint").alias("rank"), "is_best", "path"))
on_groups("filter_min_similarity", "SELECT group_id, path FROM groups WHERE is_best OR similarity >= 80", lambda g: g.where(P.reaches_similarity(F.col("is_best"), F.col("similarity"), 80.0)).select("group_id", "path"))
on_groups("filtered_groups", """, kept AS (SELECT * FROM groups WHERE (is_best OR similarity >= 75) AND contains(lower(path), '/brand') AND mipmap_count <= 1 AND width >= 64 AND height >= 64)
SELECT group_id, path FROM kept QUALIFY count(*) OVER (PARTITION BY group_id) >= 2""", lambda g: views.filtered_groups(g, "/Brand", 75.0, ("missing_mips",)).select("group_id", "path"))
on_groups("remove_path", """, kept AS (SELECT * FROM groups WHERE lower(path) <> (SELECT min(lower(path)) FROM groups))
SELECT group_id, path FROM kept QUALIFY count(*) OVER (PARTITION BY group_id) >= 2""",
          lambda g: views.without_path(g, g.agg(F.min(F.lower("path"))).first()[0].replace("/", "\\")).select("group_id", "path"))
on_groups("groups_by_count", "SELECT group_id, count(*) AS measure, row_number() OVER (ORDER BY count(*) DESC, group_id) AS place FROM groups GROUP BY group_id", lambda g: views.group_order(g, "count"))
on_groups("groups_by_total_size", "SELECT group_id, CAST(sum(file_size) AS BIGINT) AS measure, row_number() OVER (ORDER BY sum(file_size) DESC, group_id) AS place FROM groups GROUP BY group_id", lambda g: views.group_order(g, "total_size"))
on_groups("groups_by_first_path", "SELECT group_id, path AS measure, row_number() OVER (ORDER BY path, group_id) AS place FROM groups WHERE rank = 1", lambda g: views.group_order(g, "first_path"))
on_groups("group_max_similarity", "SELECT group_id, greatest(0, max(similarity)) AS best FROM groups GROUP BY group_id", lambda g: g.groupBy("group_id").agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("best")))
on_groups("sort_groups_pinned", """, heads AS (SELECT group_id, row_number() OVER (ORDER BY file_size DESC, group_id) AS group_place FROM groups WHERE rank = 1)
SELECT group_id, path, group_place, row_number() OVER (PARTITION BY group_id ORDER BY rank > 1, file_size DESC, path) AS row_place FROM groups JOIN heads USING (group_id)""",
          lambda g: views.sort_groups(g, "file_size", True).select("group_id", "path", "group_place", "row_place"))
on_groups("paginate_groups", """, heads AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS place FROM groups GROUP BY group_id)
SELECT group_id, place, least(1, greatest(1, CAST(ceil((SELECT count(*) FROM heads) / 100.0) AS BIGINT)) - 1) AS page FROM heads
WHERE (place - 1) // 100 = least(1, greatest(1, CAST(ceil((SELECT count(*) FROM heads) / 100.0) AS BIGINT)) - 1)""", lambda g: _paged_groups(g))


def _paged_groups(g: DataFrame) -> DataFrame:
    heads = g.select("group_id").distinct()
    return views.page(heads, heads.count(), 50, 1, F.asc("group_id")).select("group_id", "place", "page")


on_groups("select_except_best", "SELECT DISTINCT path FROM groups WHERE rank > 1", views.select_except_best)
on_groups("link_pairs", """, checked AS (SELECT path FROM groups WHERE asset_id % 3 = 0)
SELECT DISTINCT b.path AS original, g.path AS duplicate FROM groups g JOIN groups b ON g.group_id = b.group_id AND b.rank = 1 WHERE g.path IN (SELECT path FROM checked) AND g.path <> b.path""",
          lambda g: views.link_pairs(g, g.where("asset_id % 3 = 0")))
on_groups("selected_files", "SELECT group_id, path FROM groups WHERE path IN (SELECT path FROM groups WHERE asset_id % 3 = 0)", lambda g: views.selected(g, g.where("asset_id % 3 = 0")).select("group_id", "path"))
on_groups("display_rows", f""", heads AS (SELECT group_id, 0 AS line, 'header' AS kind, printf('%d files', count(*)) AS title, CAST(sum(file_size) AS BIGINT) AS b, NULL::BIGINT AS grid FROM groups GROUP BY group_id)
SELECT group_id, CAST(line AS BIGINT) AS line, kind, title, {_log_size('b')} AS text, grid FROM heads
UNION ALL SELECT group_id, rank, 'detail', {NAME}, {_log_size('file_size')}, (rank - 1) // 4 FROM groups WHERE group_id NOT IN (SELECT group_id FROM groups WHERE rank = 1 AND asset_id % 4 = 0)""",
          lambda g: views.display_rows(g, g.where("rank = 1 and asset_id % 4 = 0")))
on_groups("spec_matrix", f""", facts AS (SELECT group_id, rank, unnest([{{'fact': 'name', 'value': {NAME}}}, {{'fact': 'size', 'value': {_log_size('file_size')}}}, {{'fact': 'resolution', 'value': concat(width, ' x ', height)}},
  {{'fact': 'format', 'value': compression_format}}, {{'fact': 'depth', 'value': concat(bit_depth, '-bit')}}, {{'fact': 'color_space', 'value': color_space}},
  {{'fact': 'mips', 'value': CASE WHEN mipmap_count <= 1 THEN 'No' ELSE CAST(mipmap_count AS VARCHAR) END}}, {{'fact': 'alpha', 'value': CASE WHEN has_alpha THEN 'Yes' ELSE 'No' END}},
  {{'fact': 'similarity', 'value': CASE WHEN rank = 1 THEN '-' ELSE printf('%.1f%%', similarity) END}}]) AS f FROM groups)
SELECT d.group_id, d.rank, d.f.fact AS fact, b.f.value AS original, d.f.value AS duplicate FROM facts d JOIN facts b ON d.group_id = b.group_id AND d.f.fact = b.f.fact AND b.rank = 1 WHERE d.rank > 1""", views.spec_matrix)
on_groups("contact_sheet_layout", """, heads AS (SELECT group_id, row_number() OVER (ORDER BY count(*) DESC, group_id) AS gp FROM groups GROUP BY group_id),
laid AS (SELECT g.group_id, path, similarity, gp, row_number() OVER (PARTITION BY g.group_id ORDER BY similarity DESC, path) - 1 AS i FROM groups g JOIN heads USING (group_id) WHERE gp <= 50)
SELECT group_id, path, CASE WHEN i < 50 THEN printf('group_%03d.png', gp) ELSE printf('group_%03d_part_%d.png', gp, i // 50 + 1) END AS sheet, (i % 50) // 5 AS "row", (i % 50) % 5 AS col,
  CASE WHEN similarity >= 99.9 THEN '[BEST REPRESENTATION]' ELSE '' END AS mark FROM laid WHERE i < 200""", reports.contact_sheets)

# Sorts and pages of the inventory

_SORT_SQL = {"name": f"lower({NAME})", "path": "lower(path)", "size": "file_size", "compression": "lower(compression_format)", "area": "width * height", "mips": "mipmap_count", "cubemap": "is_cubemap"}
for _key, _expr in _SORT_SQL.items():
    _down = _key in ("size", "area")
    on_assets(f"sort_inventory_{_key}", f"SELECT asset_id, row_number() OVER (ORDER BY {_expr} {'DESC' if _down else 'ASC'}, asset_id) AS place FROM assets",
              lambda a, k=_key, down=_down: views.sorted_view(a, k, down).select("asset_id", "place"))
on_assets("sort_preset_0", "SELECT asset_id, row_number() OVER (ORDER BY lower(compression_format), asset_id) AS place FROM assets", lambda a: views.sorted_view(a, "compression").select("asset_id", "place"))
on_assets("sort_preset_1", "SELECT asset_id, row_number() OVER (ORDER BY file_size DESC, asset_id) AS place FROM assets", lambda a: views.sorted_view(a, "size", True).select("asset_id", "place"))
on_assets("sort_preset_2", "SELECT asset_id, row_number() OVER (ORDER BY lower(path), asset_id) AS place FROM assets", lambda a: views.sorted_view(a, "path").select("asset_id", "place"))
on_assets("paginate_inventory", """
WITH placed AS (SELECT asset_id, row_number() OVER (ORDER BY path) AS place FROM assets), last AS (SELECT greatest(1, CAST(ceil(count(*) / 250.0) AS BIGINT)) - 1 AS n FROM assets)
SELECT asset_id, place, least(3, n) AS page FROM placed, last WHERE (place - 1) // 250 = least(3, n)
""", lambda a: views.page(a, a.count(), 250, 3, F.asc("path")).select("asset_id", "place", "page"))

# Scalars

on_assets("format_size", f"SELECT asset_id, {_log_size('file_size')} AS text FROM assets", lambda a: a.select("asset_id", S.format_size(F.col("file_size")).alias("text")))
on_assets("similarity_label", "SELECT asset_id, CASE WHEN asset_id % 10 = 0 THEN '[Best]' WHEN s > 0 THEN printf('%.1f%%', s) ELSE '-' END AS label FROM (SELECT asset_id, (1 - (asset_id % 65) / 64.0::DOUBLE) * 100 AS s FROM assets) t",
          lambda a: a.select("asset_id", S.similarity_label(S.hash_similarity(F.col("asset_id") % 65), F.col("asset_id") % 10 == 0).alias("label")))
on_assets("path_parts", f"SELECT asset_id, {NAME} AS name, {STEM} AS stem, lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1)) AS ext, regexp_replace(path, '/[^/]*$', '') AS parent FROM assets",
          lambda a: a.select("asset_id", (n := S.file_name(F.col("path"))).alias("name"), S.stem(n).alias("stem"), S.extension(n).alias("ext"), S.parent(F.col("path")).alias("parent")))
on_assets("normalize_path", "SELECT asset_id, lower(replace(concat('C:', replace(path, '/', '\\')), '\\', '/')) AS path FROM assets",
          lambda a: a.select("asset_id", S.normalize_path(F.concat(F.lit("C:"), F.translate("path", "/", "\\"))).alias("path")))


@query("SELECT file_id, content_hash FROM files", "files")
def content_hash(s, d):
    return X.table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.md5("text").alias("content_hash"))


@query("SELECT a.vec_id, bit_count(xor(a.h, b.h))::INTEGER AS distance, (1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE) * 100 AS similarity FROM dhash a, dhash b WHERE b.vec_id = 0", "dhash")
def hamming(s, d):
    h = X.dhash(s, d)
    first = h.where("vec_id = 0").select(F.col("h").alias("q"))  # one row
    distance = S.hamming(F.col("h"), F.col("q"))
    return h.crossJoin(F.broadcast(first)).select("vec_id", distance.alias("distance"), S.hash_similarity(distance).alias("similarity"))


def _contains(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


on_assets("estimate_vram", f"""
WITH f AS (SELECT *, upper(compression_format) AS n FROM assets),
u AS (SELECT *, {_contains('n', ['BC', 'DXT', 'ATI'])} AS packed FROM f),
v AS (SELECT *, CAST(CASE WHEN packed THEN (CASE WHEN {_contains('n', S.SMALL_BLOCKS)} THEN 8 WHEN {_contains('n', S.LARGE_BLOCKS)} THEN 16 ELSE 0 END)
  WHEN {_contains('n', ['RGBA8', 'BGRA8'])} OR (contains(n, 'UNCOMPRESSED') AND contains(n, 'ALPHA')) THEN 4
  WHEN {_contains('n', ['RGB8', 'BGR8', 'UNCOMPRESSED'])} THEN 3 WHEN contains(n, 'RGBA16') THEN 8 WHEN contains(n, 'RGBA32') THEN 16 ELSE 4 END AS BIGINT) AS unit, CASE WHEN packed THEN 4 ELSE 1 END AS edge FROM u),
l AS (SELECT asset_id, is_cubemap, unit, edge, CAST(greatest(1, width // CAST(pow(2, i) AS BIGINT)) AS BIGINT) AS w, CAST(greatest(1, height // CAST(pow(2, i) AS BIGINT)) AS BIGINT) AS h
  FROM (SELECT *, unnest(range(0, greatest(mipmap_count, 1))) AS i FROM v) t)
SELECT asset_id, CAST(sum((((w + edge - 1) // edge * unit + 255) // 256) * 256 * ((h + edge - 1) // edge)) * CASE WHEN is_cubemap THEN 6 ELSE 1 END AS BIGINT) AS vram FROM l GROUP BY asset_id, is_cubemap
""", lambda a: a.select("asset_id", S.estimate_vram(*(F.col(c) for c in ("width", "height", "compression_format", "mipmap_count", "is_cubemap"))).alias("vram")))

on_assets("payload_bytes", f"""
WITH f AS (SELECT *, upper(compression_format) AS n, ((width + 3) // 4) * ((height + 3) // 4) AS blocks FROM assets),
t AS (SELECT *, CASE WHEN {_contains('n', S.SMALL_BLOCKS)} THEN blocks * 8 WHEN {_contains('n', S.LARGE_BLOCKS)} THEN blocks * 16 ELSE width * height * 4 END AS total FROM f)
SELECT asset_id, CAST(CASE WHEN width BETWEEN 1 AND 16384 AND height BETWEEN 1 AND 16384 AND total <= 268435456 THEN total ELSE 0 END AS BIGINT) AS bytes FROM t
""", lambda a: a.select("asset_id", S.payload_bytes(F.col("width"), F.col("height"), F.col("compression_format")).alias("bytes")))

_DIMS_TEXT = "concat(CASE WHEN asset_id % 6 = 0 THEN '-' ELSE '' END, width * (asset_id % 3), CASE asset_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN ' X ' WHEN 2 THEN '*' ELSE '/' END, height)"
_DIM = "TRY_CAST(regexp_extract(t, '^[\\t ]*\\+?([0-9]+)[\\t ]*[xX*][\\t ]*\\+?([0-9]+)[\\t ]*$', {k}) AS BIGINT)"


def _dims(a: DataFrame) -> DataFrame:
    w, h = S.parse_dims(F.expr(_DIMS_TEXT))
    return a.select("asset_id", w.alias("width"), h.alias("height"))


on_assets("parse_dims", f"""
WITH p AS (SELECT asset_id, {_DIM.format(k=1)} AS w, {_DIM.format(k=2)} AS h FROM (SELECT asset_id, {_DIMS_TEXT} AS t FROM assets) x)
SELECT asset_id, CASE WHEN w BETWEEN 1 AND 16384 AND h BETWEEN 1 AND 16384 THEN w END AS width, CASE WHEN w BETWEEN 1 AND 16384 AND h BETWEEN 1 AND 16384 THEN h END AS height FROM p
""", _dims)
on_assets("elide_text", "SELECT asset_id, CASE WHEN length(path) > 40 THEN concat(left(path, 18), '...', right(path, 18)) ELSE path END AS text FROM assets", lambda a: a.select("asset_id", S.elide(F.col("path")).alias("text")))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def escape_html(s, d):
    return X.table(s, d, "pages").select("page_id", F.md5(S.escape_html(F.col("html"))).alias("escaped"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 4) + 0.0::DOUBLE) AS v FROM embeddings")
def l2_normalize(s, d):
    v = X.table(s, d, "embeddings")
    return v.select("vec_id", F.transform(S.l2_normalize(F.col("embedding")), lambda x: F.round(x, 4) + 0.0).alias("v"))  # no negative zeros


# Exact duplicates

_EXACT = """
WITH shared AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY file_size DESC, path) AS rank FROM files WHERE file_size > 0 AND content_hash IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY content_hash) > 1)
"""


@query(_EXACT + "SELECT content_hash, rank::INTEGER AS rank, rank = 1 AS is_best, path, file_size, 100.0::DOUBLE AS similarity FROM shared", "files")
def exact_duplicates(s, d):
    return dups.exact_groups(X.files(s, d))


@query(_EXACT + f"""
, n AS (SELECT count(*) FILTER (WHERE rank = 1) AS groups, count(*) AS m, CAST(coalesce(sum(file_size) FILTER (WHERE rank > 1), 0) AS BIGINT) AS w FROM shared)
SELECT groups, CASE WHEN m > 0 THEN m ELSE (SELECT count(*) FROM files) END AS processed, w AS wasted_bytes, {_log_size('w')} AS wasted FROM n""", "files")
def report_summary(s, d):
    groups = dups.exact_groups(X.files(s, d)).withColumnRenamed("content_hash", "group_id")
    none = s.createDataFrame([], "path string, issue string")
    return reports.summary(groups, none, X.files(s, d))


# Hashes and vectors


@query("SELECT vec_id, h FROM dhash", "dhash")
def dhash(s, d):
    return X.dhash(s, d).select("vec_id", "h")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM dhash a JOIN dhash b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= {HAMMING}", "dhash")
def hamming_pairs(s, d):
    return pairs.hamming_pairs(X.dhash(s, d).select(F.col("vec_id").alias("id"), "h"), HAMMING)


@query("SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM v a JOIN v b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 6".join(
    ["WITH v AS (SELECT vec_id * 2 AS k, h FROM dhash UNION ALL SELECT vec_id * 2 + 1, xor(h, CAST(pow(2, vec_id % 60) + pow(2, (vec_id * 7 + 1) % 62) AS BIGINT)) FROM dhash)\n", ""]), "dhash")
def hamming_pairs_banded(s, d):
    h = X.dhash(s, d)
    near = h.select((F.col("vec_id") * 2 + 1).alias("id"), F.col("h").bitwiseXOR((F.pow(F.lit(2), F.col("vec_id") % 60) + F.pow(F.lit(2), (F.col("vec_id") * 7 + 1) % 62)).cast("bigint")).alias("h"))
    return pairs.hamming_pairs(h.select((F.col("vec_id") * 2).alias("id"), "h").union(near), 6)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))"
_PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return X.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(f"SELECT a, b, round(s, 4) AS similarity FROM ({_PAIRS}) t WHERE s >= {COSINE}")
def cosine_pairs(s, d):
    return pairs.cosine_pairs(_vectors(s, d), COSINE).select("a", "b", F.round("similarity", 4).alias("similarity"))


_COMPONENTS = f"""
WITH RECURSIVE pairs AS MATERIALIZED (SELECT a, b FROM ({_PAIRS}) t WHERE s >= {COSINE}),
e AS (SELECT a AS s, b AS t FROM pairs UNION SELECT b, a FROM pairs),
r(v, c) AS (SELECT s, s FROM e UNION SELECT e.t, r.c FROM r JOIN e ON e.s = r.v),
comp AS (SELECT v AS node, min(c) AS component FROM r GROUP BY v)
"""


@query(_COMPONENTS + "SELECT node, component FROM comp")
def components(s, d):
    p = pairs.cosine_pairs(_vectors(s, d), COSINE)
    return connected_components(p.select(F.col("a").alias("src"), F.col("b").alias("dst")))


#: Sizes that a vector's picture would have.
_SHAPE = {"width": "64 * (1 + {id} % 4)", "height": "32 * (1 + {id} % 3)", "file_size": "1000 + {id} % 17"}
_MEMBERS = ", ".join(f"{e.format(id='vec_id')} AS {c}" for c, e in _SHAPE.items())


def _shaped(df: DataFrame) -> DataFrame:
    return df.withColumns({"path": F.concat(F.lit("/v/"), F.col("id").cast("string"), F.lit(".png")), **{c: F.expr(e.format(id="id")) for c, e in _SHAPE.items()}})


_RANKED = f"""
ranked AS (SELECT component, vec_id, concat('/v/', vec_id, '.png') AS path, {{payload}}, row_number() OVER (PARTITION BY component ORDER BY w * h DESC, z DESC, concat('/v/', vec_id, '.png')) AS rank
  FROM (SELECT component, vec_id, {{payload}}, {_SHAPE['width'].format(id='vec_id')} AS w, {_SHAPE['height'].format(id='vec_id')} AS h, {_SHAPE['file_size'].format(id='vec_id')} AS z FROM comp JOIN {{source}} ON node = vec_id) t)
"""


@query(_COMPONENTS + ", " + _RANKED.format(payload="embedding", source="embeddings") + f"""
SELECT a.component, a.path, a.rank::INTEGER AS rank, CASE WHEN a.rank = 1 THEN 100.0::DOUBLE ELSE round(greatest(0, least(100, {_DOT.format(a='a.embedding', b='b.embedding')} * 100)), 4) END AS similarity
FROM ranked a JOIN ranked b ON a.component = b.component AND b.rank = 1""")
def semantic_groups(s, d):
    groups = dups.semantic_groups(_shaped(_vectors(s, d)), COSINE)
    return groups.select("component", "path", "rank", F.round("similarity", 4).alias("similarity"))


_HASH_COMPONENTS = f"""
WITH RECURSIVE pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM dhash a JOIN dhash b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= {HAMMING}),
e AS (SELECT a AS s, b AS t FROM pairs UNION SELECT b, a FROM pairs),
r(v, c) AS (SELECT s, s FROM e UNION SELECT e.t, r.c FROM r JOIN e ON e.s = r.v),
comp AS (SELECT v AS node, min(c) AS component FROM r GROUP BY v)
"""
_PERCEPTUAL = _HASH_COMPONENTS + ", " + _RANKED.replace("{payload}, row", "fp, row").replace("vec_id, {payload}, ", "vec_id, dhash.h AS fp, ").format(source="dhash", payload="fp")


@query(_PERCEPTUAL + "SELECT a.component, a.path, a.rank::INTEGER AS rank, (1 - bit_count(xor(a.fp, b.fp)) / 64.0::DOUBLE) * 100 AS similarity FROM ranked a JOIN ranked b ON a.component = b.component AND b.rank = 1", "dhash")
def perceptual_groups(s, d):
    hashed = _shaped(X.dhash(s, d).select(F.col("vec_id").alias("id"), "h"))
    return dups.perceptual_groups(hashed, HAMMING).select("component", "path", "rank", "similarity")


@query(_PERCEPTUAL + "SELECT a.path, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM ranked a JOIN ranked b ON a.component = b.component AND b.rank = 1 WHERE a.rank > 1", "dhash")
def similarity_to_best(s, d):
    hashed = _shaped(X.dhash(s, d).select(F.col("vec_id").alias("id"), "h"))
    groups = dups.perceptual_groups(hashed, HAMMING)
    best = groups.where("is_best").select("component", F.col("h").alias("best"))
    return groups.where("rank > 1").join(best, "component").select("path", S.hamming(F.col("h"), F.col("best")).alias("distance"))


_TOP = f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
n AS (SELECT vec_id AS id, concat('/v/', vec_id {{modulo}}, '.png') AS path, 1 - {_DOT.format(a='embedding', b='q')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='q', b='q')})) AS dist FROM embeddings, q),
one AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY path ORDER BY dist, id) = 1)
SELECT row_number() OVER (ORDER BY dist, id)::INTEGER AS rank, id, path, round(dist, 4) AS distance, round(greatest(0, least(1, 1 - dist)) * 100, 2) AS similarity FROM one ORDER BY dist, id LIMIT {{limit}}
"""


def _search(s: SparkSession, d: str, limit: int, modulo: int | None) -> DataFrame:
    v = _vectors(s, d)
    asked = v.where("id = 0").first()["v"]
    key = F.col("id") if modulo is None else F.col("id") % modulo
    found = dups.search(v.withColumn("path", F.concat(F.lit("/v/"), key.cast("string"), F.lit(".png"))), asked, limit)
    return found.select("rank", "id", "path", F.round("distance", 4).alias("distance"), F.round("similarity", 2).alias("similarity"))


@query(_TOP.format(modulo="", limit=250))
def vector_topk(s, d):
    return _search(s, d, 250, None)


@query(_TOP.format(modulo="% 100", limit=50))
def semantic_search(s, d):
    return _search(s, d, 50, 100)


# Metadata rules

_ISSUES = f"""
WITH rules AS (SELECT asset_id, path, unnest([
  CASE WHEN {_NPOT} THEN {{'issue': 'Non-Power-Of-Two (NPOT)', 'details': ''}} END,
  CASE WHEN width % 4 <> 0 OR height % 4 <> 0 THEN {{'issue': 'Bad Block Alignment (Not divisible by 4)', 'details': ''}} END,
  CASE WHEN least(width, height) >= 64 AND mipmap_count <= 1 THEN {{'issue': 'Missing Mipmaps', 'details': ''}} END,
  CASE WHEN bit_depth > 8 THEN {{'issue': concat('High Bit Depth (', bit_depth, '-bit)'), 'details': ''}} END,
  CASE WHEN {_contains('lower(path)', P.DATA_TAGS)} AND lower(color_space) = 'srgb' THEN {{'issue': 'Color Space Misconfiguration', 'details': 'Data map texture matches specified data tags but is encoded as sRGB. Data textures must use Linear color space.'}} END,
  CASE WHEN width > 4096 OR height > 4096 THEN {{'issue': 'Oversized Texture (>4096px)', 'details': concat('Texture resolution ', width, 'x', height, ' exceeds configured project limit of 4096px.')}} END
]) AS r FROM assets),
issues AS (SELECT path, r.issue AS issue, r.details AS details FROM rules WHERE r IS NOT NULL)
"""
on_assets("qc_audit", _ISSUES + "SELECT * FROM issues", qc.audit)
on_assets("qc_absolute", _ISSUES + "SELECT * FROM issues WHERE details = ''", lambda a: qc.melt(a, qc.absolute_rules(), "path"))
on_assets("qc_colorspace", _ISSUES + "SELECT * FROM issues WHERE issue LIKE 'Color%'", lambda a: qc.melt(a, [qc.color_space_rule()], "path"))
on_assets("qc_oversize", _ISSUES + "SELECT * FROM issues WHERE issue LIKE 'Oversized%'", lambda a: qc.melt(a, [qc.oversize_rule()], "path"))
on_assets("issue_counts", _ISSUES + "SELECT issue, count(*) AS n FROM issues GROUP BY issue", lambda a: qc.audit(a).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy("issue"))
on_assets("remove_issue_type", _ISSUES + "SELECT * FROM issues WHERE issue <> 'Missing Mipmaps'", lambda a: qc.audit(a).where("issue <> 'Missing Mipmaps'"))
on_assets("select_all", _ISSUES + ", " + _GROUPS.strip()[5:] + "SELECT path FROM issues UNION SELECT path FROM groups UNION SELECT path FROM assets WHERE is_cubemap",
          lambda a: views.select_all(qc.audit(a), asset_groups(a), a.where("is_cubemap")))
on_assets("select_none", "SELECT path FROM assets WHERE false", views.select_none)
on_assets("select_invert", "SELECT path FROM assets WHERE path NOT IN (SELECT path FROM assets WHERE asset_id % 3 = 0)", lambda a: views.select_invert(a, a.where("asset_id % 3 = 0")))
on_assets("csv_export", _ISSUES + f"""
SELECT {NAME} AS "File Name", compression_format AS "Format", concat(width, ' x ', height) AS "Dimensions", CAST(mipmap_count AS VARCHAR) AS "MipMaps", CASE WHEN is_cubemap THEN 'YES' ELSE 'NO' END AS "Cubemap", {_log_size('file_size')} AS "Size", path AS "Full Path" FROM assets
UNION ALL SELECT {NAME}, concat('QC Issue: ', issue), '-', '-', '-', '-', path FROM issues""", lambda a: reports.csv_rows(a, qc.audit(a)))
_LONGEST = {"name": NAME, "path": "path", "size": _log_size("file_size"), "format": "compression_format", "resolution": "concat(width, ' x ', height)"}
on_assets("column_widths", " UNION ALL ".join(f"SELECT '{k}' AS \"column\", CAST(greatest(8, least(60, max(length({v})))) AS BIGINT) AS width FROM assets" for k, v in _LONGEST.items()), views.column_widths)

_RELATIVE = """
WITH a AS (SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^(.+?)(\\.[^.]*)?$', 1)) AS key FROM folder_a QUALIFY row_number() OVER (PARTITION BY key ORDER BY path DESC) = 1),
b AS (SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^(.+?)(\\.[^.]*)?$', 1)) AS key FROM folder_b),
rules AS (SELECT b.path AS path, concat('Compared to Folder A version (', regexp_extract(a.path, '[^/]*$'), ')') AS details, unnest([
  CASE WHEN b.width * b.height < a.width * a.height THEN 'Resolution Downgrade' END,
  CASE WHEN b.file_size > floor(a.file_size * 1.5) THEN 'Size Bloat (>1.5x File Size)' END,
  CASE WHEN a.has_alpha AND NOT b.has_alpha THEN 'Lost Alpha Channel' END,
  CASE WHEN a.color_space <> b.color_space THEN concat('Color Space Mismatch (', a.color_space, ' -> ', b.color_space, ')') END,
  CASE WHEN upper(a.compression_format) <> upper(b.compression_format) THEN concat('Format Transition (', a.compression_format, ' -> ', b.compression_format, ')') END]) AS issue FROM a JOIN b ON a.key = b.key)
SELECT path, issue, details FROM rules WHERE issue IS NOT NULL
"""


@query(_RELATIVE, "folder_a", "folder_b")
def folder_compare(s, d):
    return qc.compare_folders(X.folder(s, d, "A"), X.folder(s, d, "B"))


@query(_RELATIVE.replace("SELECT path, issue, details FROM rules WHERE issue IS NOT NULL", "SELECT issue, count(*) AS n FROM rules WHERE issue IS NOT NULL GROUP BY issue"), "folder_a", "folder_b")
def qc_relative(s, d):
    return qc.compare_folders(X.folder(s, d, "A"), X.folder(s, d, "B")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


# Incremental cache

_ITEMS = "SELECT path, 'Composite' AS channel, file_size, mtime FROM assets"
_CACHED = "SELECT path, 'Composite' AS channel, CASE WHEN asset_id % 5 = 1 THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN asset_id % 5 = 2 THEN mtime - 60 ELSE mtime END AS mtime FROM assets WHERE asset_id % 5 <> 0"
_CLASSIFY = f"""
WITH items AS ({_ITEMS}), cached AS ({_CACHED}),
states AS (SELECT i.*, CASE WHEN c.path IS NULL THEN 'new' WHEN c.file_size = i.file_size AND c.mtime = i.mtime THEN 'hit' ELSE 'changed' END AS status FROM items i LEFT JOIN cached c ON i.path = c.path AND i.channel = c.channel)
"""


def _items(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = F.lit("Composite").alias("channel")
    size = F.when(F.col("asset_id") % 5 == 1, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size")
    mtime = F.when(F.col("asset_id") % 5 == 2, F.col("mtime") - 60).otherwise(F.col("mtime")).alias("mtime")
    return a.select("path", own, "file_size", "mtime"), a.where("asset_id % 5 <> 0").select("path", own, size, mtime)


on_assets("cache_classify", _CLASSIFY + "SELECT * FROM states", lambda a: cache.classify(*_items(a)))
on_assets("cache_prune", _CLASSIFY + "SELECT * FROM cached WHERE path NOT IN (SELECT path FROM states WHERE status = 'changed')",
          lambda a: cache.prune((i := _items(a))[1], cache.classify(*i).where("status = 'changed'")))
on_assets("cache_merge", _CLASSIFY + "SELECT path, channel, file_size, mtime, CASE WHEN status = 'hit' THEN 'cached' ELSE 'fresh' END AS origin FROM states",
          lambda a: cache.merge((i := _items(a))[0], i[1].withColumn("origin", F.lit("cached")), lambda rows: rows.withColumn("origin", F.lit("fresh"))))
on_assets("cache_gc", """
WITH live AS (SELECT path, file_size, mtime AS last_used, CASE WHEN mtime < 1700000000 + 60 * (SELECT count(*) FROM assets) - 30 * (SELECT count(*) FROM assets) THEN 'idle' END AS idle FROM assets),
run AS (SELECT *, CASE WHEN idle IS NULL THEN sum(CASE WHEN idle IS NULL THEN file_size END) OVER (ORDER BY last_used DESC, path DESC ROWS UNBOUNDED PRECEDING) END AS s FROM live)
SELECT path, file_size, last_used, CASE WHEN idle IS NOT NULL THEN 'idle' WHEN s <= 50000000 THEN 'kept' ELSE 'evicted' END AS fate FROM run
""", lambda a: _garbage(a))


def _garbage(a: DataFrame) -> DataFrame:
    n = a.count()
    entries = a.select("path", "file_size", F.col("mtime").alias("last_used"))
    # The fixture's files are a minute apart; the idle limit is moved to the middle of them.
    return cache.collect_garbage(entries, 1_700_000_000 + 60 * n - 30 * n + 14 * 86_400, most_bytes=50_000_000)


on_assets("analysis_items", """
SELECT path, unnest(CASE WHEN contains(lower(path), '_orm') OR contains(lower(path), '_rough') THEN ['R', 'G', 'A'] ELSE ['Luminance'] END) AS channel FROM assets
""", lambda a: analysis_items(a, "_orm, _rough", "RGA", luminance=True))


def analysis_items(assets: DataFrame, tags: str, channels: str, luminance: bool = False) -> DataFrame:
    """path and channel: the chosen channels of tagged files, one view of the others."""
    split = F.array(*[F.lit(c) for c in channels])
    other = F.array(F.lit("Luminance" if luminance else "Composite"))
    return assets.select("path", F.explode(F.when(P.has_tag(F.col("path"), P.tags_of(tags)) & F.lit(bool(channels)), split).otherwise(other)).alias("channel"))


# Rasters

_LUMA = "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"
_HDR = ("hdr AS (SELECT img, y, x, r / 64.0::DOUBLE AS r, g / 64.0::DOUBLE AS g, b / 64.0::DOUBLE AS b, a / 255.0::DOUBLE AS a FROM px)")


def _hdr(px: DataFrame) -> DataFrame:
    return px.select("img", "y", "x", *[(F.col(c) / F.lit(64.0)).alias(c) for c in "rgb"], (F.col("a") / F.lit(255.0)).alias("a"))


on_px("luma_histogram", f"""
WITH c AS (SELECT img, CAST(round({_LUMA}) AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY 1, 2),
s AS (SELECT img, unnest(range(256)) AS bin FROM (SELECT DISTINCT img FROM px) i)
SELECT s.img, s.bin, coalesce(n, 0) AS n, CAST(round(coalesce(n, 0) / greatest(1, max(coalesce(n, 0)) OVER (PARTITION BY s.img))::DOUBLE * 95) AS BIGINT) AS bar FROM s LEFT JOIN c ON s.img = c.img AND s.bin = c.bin
""", pixels.luma_histogram)
on_px("auto_exposure", f"""
WITH {_HDR}, m AS (SELECT img, pow(2, sum(log2(greatest({_LUMA}, 0) + 1e-5)) / count(*)) AS g FROM hdr GROUP BY img)
SELECT img, round(CASE WHEN g > 1e-5 THEN greatest(0.01, least(100, 0.18 / g)) ELSE 1.0 END, 6) AS exposure FROM m
""", lambda p: pixels.auto_exposure(_hdr(p)).select("img", F.round("exposure", 6).alias("exposure")))
on_px("scene_peak", f"WITH {_HDR} SELECT img, round(CASE WHEN max({_LUMA}) > 0 THEN greatest(100, max({_LUMA}) * 100) ELSE 1000 END, 6) AS peak_nits FROM hdr GROUP BY img",
      lambda p: pixels.scene_peak(_hdr(p)).select("img", F.round("peak_nits", 6).alias("peak_nits")))
_CHANNELS = "WITH l AS (SELECT img, y, x, unnest([{'c': 'R', 'v': r}, {'c': 'G', 'v': g}, {'c': 'B', 'v': b}, {'c': 'A', 'v': a}]) AS c FROM px), m AS (SELECT img, c.c AS channel, min(c.v) AS low, max(c.v) AS high FROM l GROUP BY 1, 2)\n"
on_px("empty_channels", _CHANNELS + "SELECT img, channel, low, high, high - low < 245 AS flat FROM m", lambda p: pixels.channel_ranges(p, 245))
on_px("channel_split", _CHANNELS + "SELECT l.img, l.c.c AS channel, y, x, l.c.v AS v FROM l JOIN m ON l.img = m.img AND l.c.c = m.channel WHERE high - low >= 250", lambda p: pixels.channel_planes(p, 250))
_VFX = "CASE WHEN avg(CASE WHEN a > 10 THEN 1.0::DOUBLE ELSE 0 END) <= 0.001 AND max(greatest(r, g, b)) > 0 THEN true ELSE false END"
_GHOST = "(SELECT img, y, x, r, g, b, CASE WHEN img = 3 THEN 0 WHEN img = 4 THEN 255 ELSE a END AS a FROM px)"


def _ghost(p: DataFrame) -> DataFrame:
    """One raster made transparent, one opaque, so that every case occurs."""
    return p.withColumn("a", F.when(F.col("img") == 3, F.lit(0)).when(F.col("img") == 4, F.lit(255)).otherwise(F.col("a")).cast("bigint"))


on_px("vfx_transparent", f"SELECT img, {_VFX} AS vfx FROM {_GHOST} t GROUP BY img", lambda p: pixels.vfx_transparent(_ghost(p)))
_MIX = ", ".join(f"CASE WHEN keep THEN {c} ELSE CAST(floor({c} * (a / 255.0::DOUBLE) + 128 * (1 - a / 255.0::DOUBLE)) AS BIGINT) END AS {c}" for c in "rgb")
on_px("composite_gray", f"WITH t AS {_GHOST}, f AS (SELECT img, min(a) = 255 OR {_VFX} AS keep FROM t GROUP BY img) SELECT t.img, y, x, {_MIX} FROM t JOIN f ON t.img = f.img", lambda p: pixels.over_gray(_ghost(p)))
on_px("channel_preview", "SELECT img, y, x, r, g, 0::BIGINT AS b, 255::BIGINT AS a FROM px", lambda p: pixels.channel_preview(p, "RG"))
on_px("channel_preview_single", "SELECT img, y, x, b AS r, b AS g, b, 255::BIGINT AS a FROM px", lambda p: pixels.channel_preview(p, "B"))
_TWO = "FROM px p JOIN px q ON p.y = q.y AND p.x = q.x AND p.img = 0 AND q.img = 1"
on_px("diff_map", f"SELECT p.y, p.x, abs(p.r - q.r) AS r, abs(p.g - q.g) AS g, abs(p.b - q.b) AS b, 255::BIGINT AS a {_TWO}", lambda p: pixels.difference(p, 0, 1))
on_px("diff_heatmap", f"SELECT y, x, i AS r, 0::BIGINT AS g, 255 - i AS b, 255::BIGINT AS a FROM (SELECT p.y AS y, p.x AS x, (abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) + abs(p.a - q.a)) // 4 AS i {_TWO}) t", lambda p: pixels.difference_heat(p, 0, 1))


def _lut(c: str, brightness: float, contrast: float, gamma: float) -> str:
    v = f"(({c} / 255.0::DOUBLE * {brightness} - 0.5) * {contrast} + 0.5)"
    return f"CAST(floor(greatest(0, least(1, CASE WHEN {v} > 0 THEN pow({v}, {gamma}) ELSE {v} END)) * 255) AS BIGINT)"


on_px("color_lut", "SELECT img, y, x, " + ", ".join(f"{_lut(c, 1.1, 1.2, 0.8)} AS {c}" for c in "rgb") + ", a FROM px", lambda p: pixels.correct_colors(p, 1.1, 1.2, 0.8))
_SPRITE = "(SELECT p.img, y - ch * {row} AS y, x - cw * {col} AS x, r, g, b, a FROM px p JOIN (SELECT img, (max(x) + 1) // 4 AS cw, (max(y) + 1) // 3 AS ch FROM px GROUP BY img) s ON p.img = s.img WHERE x >= cw * {col} AND x < cw * ({col} + 1) AND y >= ch * {row} AND y < ch * ({row} + 1))"
on_px("sprite_slice", f"SELECT * FROM {_SPRITE.format(row=1, col=2)} t", lambda p: pixels.sprite(p, 4, 3, 18))
on_px("viewport_chain", "SELECT img, y, x, " + ", ".join(f"{_lut(c, 0.9, 1.3, 1.5)} AS {c}" for c in "rgb") + f", 255::BIGINT AS a FROM (SELECT img, y, x, r, g, 0 AS b FROM {_SPRITE.format(row=1, col=2)} s) t", lambda p: pixels.viewport(p, "RG", 18, 4, 3, 0.9, 1.3, 1.5))


def _resized(source: str, width: str, height: str) -> str:
    """Relations up to ``small``, which has the rasters of ``source`` in another size; each new pixel gathers the old ones within reach."""
    axis = lambda name, old, new: (
        f"{name}0 AS (SELECT img, {old}, {old} / {new}::DOUBLE AS scale, unnest(range({new})) AS k FROM z), {name}1 AS (SELECT img, scale, k, unnest(range({old})) AS o FROM {name}0),\n"
        f"{name} AS (SELECT * FROM (SELECT img, k, o, 1 - abs(o - ((k + 0.5::DOUBLE) * scale - 0.5::DOUBLE)) / greatest(1.0::DOUBLE, scale) AS wt FROM {name}1) u WHERE wt > 0)"
    )
    mean = ", ".join(f"CAST(round(round(sum({c} * zx.wt * zy.wt) / sum(zx.wt * zy.wt), 6)) AS BIGINT) AS {c}" for c in "rgba")
    return f"""z AS (SELECT img, w, h, CAST({width} AS BIGINT) AS nw, CAST({height} AS BIGINT) AS nh FROM (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY img) u),
{axis("zx", "w", "nw")}, {axis("zy", "h", "nh")},
small AS (SELECT p.img, zy.k AS y, zx.k AS x, {mean} FROM {source} p JOIN zx ON zx.img = p.img AND zx.o = p.x JOIN zy ON zy.img = p.img AND zy.o = p.y GROUP BY p.img, zy.k, zx.k)"""


on_px("aspect_resize", f"WITH {_resized('px', 'floor(greatest(1.0, w * 1.5))', 'h')} SELECT * FROM small", lambda p: pixels.with_aspect(p, 1.5))
on_px("raster_resize", f"WITH {_resized('px', '7', '5')} SELECT * FROM small", lambda p: pixels.resized(p, F.lit(7), F.lit(5)))
_SEEN = "seen AS (SELECT img, y, x, " + ", ".join(f"{_lut(c, 0.9, 1.3, 1.5)} AS {c}" for c in "rgb") + f", 255::BIGINT AS a FROM {_SPRITE.format(row=0, col=0)} s WHERE img IN (0, 1)), {_resized('seen', 'floor(greatest(1.0, w * 0.5))', 'h')}"
_CHAIN = dict(channels="RGB", frame=0, columns=4, rows=3, brightness=0.9, contrast=1.3, gamma=1.5, ratio=0.5)
on_px("viewport_difference", f"""
WITH {_SEEN} SELECT y, x, i AS r, 0::BIGINT AS g, 255 - i AS b, 255::BIGINT AS a FROM (
  SELECT p.y AS y, p.x AS x, (abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) + abs(p.a - q.a)) // 4 AS i FROM small p JOIN small q ON p.y = q.y AND p.x = q.x AND p.img = 0 AND q.img = 1) t
""", lambda p: pixels.viewport_compare(p, 0, 1, **_CHAIN)[0])
on_px("viewport_histogram", f"""
WITH {_SEEN}, c AS (SELECT img, CAST(round(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) AS BIGINT) AS bin, count(*) AS k FROM small GROUP BY 1, 2),
f AS (SELECT s.img, s.bin, coalesce(c.k, 0) AS n FROM (SELECT img, unnest(range(256)) AS bin FROM (SELECT DISTINCT img FROM small) d) s LEFT JOIN c ON c.img = s.img AND c.bin = s.bin)
SELECT img, bin, n, CAST(round(n / greatest(1, max(n) OVER (PARTITION BY img))::DOUBLE * 95) AS BIGINT) AS bar FROM f
""", lambda p: pixels.viewport_compare(p, 0, 1, **_CHAIN)[1])
on_px("dhash_window", f"""
WITH {_resized('px', '9', '8')}, v AS (SELECT img, y, x, CAST(round(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) AS BIGINT) AS v FROM small),
n AS (SELECT *, lead(v) OVER (PARTITION BY img, y ORDER BY x) AS w FROM v)
SELECT img, CAST(coalesce(sum(CASE WHEN v > w THEN CASE WHEN y * 8 + x = 63 THEN -9223372036854775808::HUGEINT ELSE pow(2, y * 8 + x)::HUGEINT END END), 0) AS BIGINT) AS h FROM n GROUP BY img
""", pixels.dhash_of)
_N = {c: f"({c} / 255.0::DOUBLE * 2 - 1)" for c in "rgb"}
_LEN = f"sqrt({_N['r']} * {_N['r']} + {_N['g']} * {_N['g']} + {_N['b']} * {_N['b']})"
on_px("pixel_inspect", f"""
WITH s AS (SELECT max(x) FILTER (WHERE img = 0) + 1 AS ow, max(y) FILTER (WHERE img = 0) + 1 AS oh, max(x) FILTER (WHERE img = 1) + 1 AS dw, max(y) FILTER (WHERE img = 1) + 1 AS dh FROM px),
o AS (SELECT p.*, CAST(least(round(x * (dw / ow::DOUBLE)), dw - 1) AS BIGINT) AS x2, CAST(least(round(y * (dh / oh::DOUBLE)), dh - 1) AS BIGINT) AS y2 FROM px p, s WHERE img = 0),
j AS (SELECT o.*, (abs(o.r - q.r) + abs(o.g - q.g) + abs(o.b - q.b)) / 3.0::DOUBLE AS gap FROM o JOIN px q ON q.img = 1 AND q.x = o.x2 AND q.y = o.y2)
SELECT y, x, printf('#%02X%02X%02X%02X', r, g, b, a) AS hex, {", ".join(f"round(CASE WHEN {_LEN} > 1e-4 THEN {_N[c]} / {_LEN} ELSE {_N[c]} END * 100) / 100 AS normal_{n}" for c, n in zip("rgb", "xyz"))},
  concat(printf('%.1f%%', gap / 255 * 100), printf(' (Δ %.0f)', gap)) AS diff FROM j
""", lambda p: pixels.inspect(p, 0, 1))


@query("SELECT img, width, height, n FROM (SELECT img, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n FROM px GROUP BY img) t", "px")
def raster_sizes(s, d):
    return X.px(s, d).groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("n"))


# Pixel rules

on_px("qc_tiling", """
WITH s AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img HAVING max(x) >= 15 AND max(y) >= 15),
a AS (SELECT p.img, avg((abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) // 3) AS d FROM s JOIN px p ON p.img = s.img AND p.x = 0 JOIN px q ON q.img = s.img AND q.y = p.y AND q.x = w - 1 GROUP BY 1),
b AS (SELECT p.img, avg((abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) // 3) AS d FROM s JOIN px p ON p.img = s.img AND p.y = 0 JOIN px q ON q.img = s.img AND q.x = p.x AND q.y = h - 1 GROUP BY 1)
SELECT a.img, 'Non-Seamless Tiling (Edge Seam)' AS issue, printf('Opposing edges mismatch (Horizontal Seam Delta: %.1f, Vertical Seam Delta: %.1f)', round_even(a.d, 1), round_even(b.d, 1)) AS details FROM a JOIN b ON a.img = b.img WHERE a.d > 35 OR b.d > 35
""", qc.tiling)
_PLAIN = "(SELECT img, y, x, CASE WHEN img < 3 THEN 100 + (x + y) % (1 + 2 * img) ELSE r END AS r, CASE WHEN img < 3 THEN 90 ELSE g END AS g, b // CASE WHEN img = 5 THEN 64 WHEN img < 3 THEN 300 ELSE 1 END AS b, CASE WHEN img < 3 THEN 255 ELSE a END AS a FROM px)"


def _plain(p: DataFrame) -> DataFrame:
    """Some rasters made almost even, so that every case occurs."""
    even = F.col("img") < 3
    return p.select("img", "y", "x", F.when(even, 100 + (F.col("x") + F.col("y")) % (1 + 2 * F.col("img"))).otherwise(F.col("r")).alias("r"), F.when(even, F.lit(90)).otherwise(F.col("g")).cast("bigint").alias("g"),
                    F.floor(F.col("b") / F.when(F.col("img") == 5, 64).when(even, 300).otherwise(1)).cast("bigint").alias("b"), F.when(even, F.lit(255)).otherwise(F.col("a")).cast("bigint").alias("a"))


on_px("qc_solid", f"""
WITH t AS {_PLAIN}, f AS (SELECT * FROM t WHERE x = 0 AND y = 0)
SELECT t.img, 'Solid Color Texture' AS issue, printf('Image is entirely a single color: R:%d, G:%d, B:%d, A:%d', f.r, f.g, f.b, f.a) AS details FROM t JOIN f ON t.img = f.img GROUP BY t.img, f.r, f.g, f.b, f.a
HAVING max(greatest(abs(t.r - f.r), abs(t.g - f.g), abs(t.b - f.b), abs(t.a - f.a))) <= 2
""", lambda p: qc.solid(_plain(p)))
_FLAT = " ".join(f"WHEN max({c}) - min({c}) < 5 THEN printf('Channel {n} is empty/solid color (Min: %d, Max: %d). Check your packing exports.', min({c}), max({c}))" for c, n in qc.CHANNEL_NAMES.items())
on_px("qc_empty_channel", f"SELECT img, 'Empty Channel (Flat Mask)' AS issue, d AS details FROM (SELECT img, CASE {_FLAT} END AS d FROM {_PLAIN} t GROUP BY img) u WHERE d IS NOT NULL", lambda p: qc.empty_channel(_plain(p)))
_CUT = "(SELECT img, y, x, CASE WHEN (img + x) % 3 = 0 THEN r // 100 ELSE r END AS r, CASE WHEN (img + x) % 3 = 0 OR img % 2 = 0 THEN 0 ELSE g END AS g, CASE WHEN (img + x) % 3 = 0 OR img % 2 = 0 THEN 1 ELSE b END AS b, CASE WHEN (x + y * 3) % 7 < 3 THEN 4 WHEN (x + y) % 5 = 0 THEN 230 ELSE 120 END AS a FROM px)"


def _cut(p: DataFrame) -> DataFrame:
    """Rasters with holes, some of them padded with black."""
    third, dark = (F.col("img") + F.col("x")) % 3 == 0, F.col("img") % 2 == 0
    alpha = F.when((F.col("x") + F.col("y") * 3) % 7 < 3, 4).when((F.col("x") + F.col("y")) % 5 == 0, 230).otherwise(120)
    return p.select("img", "y", "x", F.when(third, F.floor(F.col("r") / 100)).otherwise(F.col("r")).alias("r"), F.when(third | dark, F.lit(0)).otherwise(F.col("g")).alias("g"), F.when(third | dark, F.lit(1)).otherwise(F.col("b")).alias("b"), alpha.alias("a"))


on_px("qc_alpha_bleed", f"""
WITH t AS {_CUT}, s AS (SELECT img, max(x) AS mx, max(y) AS my FROM t GROUP BY img),
e AS (SELECT p.* FROM t p JOIN s ON p.img = s.img WHERE p.x > 0 AND p.y > 0 AND p.x < mx AND p.y < my AND p.a < 10 AND EXISTS (SELECT 1 FROM t q WHERE q.img = p.img AND q.a > 200 AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1)),
c AS (SELECT img, count(*) AS n, sum(CASE WHEN r < 5 AND g < 5 AND b < 5 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS k FROM e GROUP BY img)
SELECT img, 'Missing Alpha Bleed (Edge Padding)' AS issue, concat(printf('%.0f', round_even(k * 100, 0)), '% of transparent boundary pixels are unpadded black RGB(0,0,0). Will cause dark outline artifacts when mipmapped in game engines.') AS details FROM c WHERE n >= 10 AND k > 0.4
""", lambda p: qc.alpha_bleed(_cut(p)))
_LEANING = "(SELECT img, y, x, r, CASE img % 3 WHEN 0 THEN least(255, g + 60) WHEN 1 THEN greatest(0, g - 60) ELSE g END AS g, b, a FROM px)"
on_px("qc_normal_orientation", f"""
WITH t AS {_LEANING}, s AS (SELECT img, max(x) + 1 AS w FROM t GROUP BY img HAVING max(x) >= 3 AND max(y) >= 3),
n AS (SELECT img, x, g, lag(g) OVER k AS u, lead(g) OVER k AS d FROM t WINDOW k AS (PARTITION BY img, x ORDER BY y)),
c AS (SELECT n.img, sum(CASE WHEN g > 128 THEN 1 ELSE 0 END) AS top, count(*) AS n FROM n JOIN s ON n.img = s.img WHERE x > 0 AND x < w - 1 AND abs(d - u) > 30 GROUP BY 1),
k AS (SELECT img, top / n::DOUBLE AS k FROM c WHERE top > 0 AND top < n)
SELECT img, 'Normal Map Orientation' AS issue, CASE WHEN k > 0.6 THEN '{qc.OPENGL_SEEN[1]}' ELSE '{qc.DIRECTX_SEEN[1]}' END AS details FROM k WHERE k > 0.6 OR k < 0.4
""", lambda p: qc.normal_orientation(p.withColumn("g", F.when(F.col("img") % 3 == 0, F.least(F.lit(255), F.col("g") + 60)).when(F.col("img") % 3 == 1, F.greatest(F.lit(0), F.col("g") - 60)).otherwise(F.col("g")))))
_TILTED = "(SELECT img, y, x, CASE WHEN img < 2 THEN 255 ELSE r END AS r, CASE WHEN img < 2 THEN 255 ELSE g END AS g, CASE WHEN img < 2 THEN 255 WHEN img = 2 THEN 20 ELSE b END AS b FROM px)"
_Z = ", ".join([f"avg({_N['b']}) AS z", f"avg(CASE WHEN sqrt({_N['r']}*{_N['r']} + {_N['g']}*{_N['g']}) - 1 > 0.15 THEN 1.0::DOUBLE ELSE 0 END) AS clip", f"avg(CASE WHEN abs({_LEN} - 1) > 0.15 THEN 1.0::DOUBLE ELSE 0 END) AS off", f"avg(CASE WHEN {_N['r']}*{_N['r']} + {_N['g']}*{_N['g']} > 1.15 THEN 1.0::DOUBLE ELSE 0 END) AS over"])


def _tilted(p: DataFrame) -> DataFrame:
    full = F.col("img") < 2
    return p.withColumns({"r": F.when(full, 255).otherwise(F.col("r")), "g": F.when(full, 255).otherwise(F.col("g")), "b": F.when(full, 255).when(F.col("img") == 2, 20).otherwise(F.col("b"))})


on_px("qc_normal_integrity", f"""
WITH k AS (SELECT img, {_Z} FROM {_TILTED} t GROUP BY img)
SELECT img, 'Bad Normal Map (XY Clip)' AS issue, concat(printf('%.0f', round_even(clip * 100, 0)), '% of pixels exceed tangent unit circle bounds') AS details FROM k WHERE z > 0.98 AND clip > 0.1
UNION ALL SELECT img, 'Bad Normal Map (Integrity)', concat(printf('%.0f', round_even(off * 100, 0)), '% of pixels have invalid vector lengths') FROM k WHERE z <= 0.98 AND off > 0.1
UNION ALL SELECT img, 'Inverted Z / Not Tangent Space', 'Z-Axis represents flat or inverted normals' FROM k WHERE z <= 0.98 AND off <= 0.1 AND z < 0.2
""", lambda p: qc.normal_integrity(_tilted(p)))
on_px("qc_normal_bc5", f"""
SELECT img, 'Bad BC5 Normal Map' AS issue, concat(printf('%.0f', round_even(over * 100, 0)), '% of pixels exceed reconstruction limits (X^2 + Y^2 > 1.0)') AS details FROM (SELECT img, {_Z} FROM {_TILTED} t GROUP BY img) k WHERE over > 0.1
""", lambda p: qc.normal_integrity(_tilted(p), bc5=True))

# Tone mapping


def _oetf(v: str) -> str:
    return f"CASE WHEN {v} <= 0.0031308 THEN 12.92 * {v} ELSE 1.055 * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END"


def _clamp(v: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v}))"


def _eight(v: str, name: str) -> str:
    return f"CAST(floor({_clamp(v)} * 255) AS BIGINT) AS {name}"


_ALPHA = _eight("a", "a")
on_px("tone_none", f"WITH {_HDR}, c AS (SELECT img, y, x, a, {', '.join(f'{_clamp(c)} AS {c}' for c in 'rgb')} FROM hdr) SELECT img, y, x, {', '.join(_eight(_oetf(c), c) for c in 'rgb')}, {_ALPHA} FROM c", lambda p: tonemap.tonemap(_hdr(p), "none"))
on_px("tone_aces", f"""
WITH {_HDR}, c AS (SELECT img, y, x, a, {', '.join(f"{_clamp(f'({c} * ({c} * 2.51::DOUBLE + 0.03)) / ({c} * ({c} * 2.43::DOUBLE + 0.59) + 0.14)')} AS {c}" for c in 'rgb')} FROM hdr)
SELECT img, y, x, {', '.join(_eight(_oetf(c), c) for c in 'rgb')}, {_ALPHA} FROM c""", lambda p: tonemap.tonemap(_hdr(p), "aces"))


def _smooth(low: float, high: float) -> str:
    t = _clamp(f"(v - {low}) / ({high}::DOUBLE - {low})")
    return f"({t} * {t} * (3.0 - {t} * 2.0))"


on_px("tone_falsecolor", f"""
WITH {_HDR}, l AS (SELECT img, y, x, a, {_clamp('(log2(greatest(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE, 1e-5)) + 10.0) * 0.071428')} AS v FROM hdr)
SELECT img, y, x, {_eight(f"{_smooth(0.5, 0.8)} + CASE WHEN v >= 0.9 THEN 1.0 ELSE 0.0 END", 'r')}, {_eight(f"{_smooth(0.2, 0.5)} - {_smooth(0.7, 0.9)}", 'g')}, {_eight(f"{_smooth(0.0, 0.2)} - {_smooth(0.4, 0.5)}", 'b')}, {_ALPHA} FROM l
""", lambda p: tonemap.tonemap(_hdr(p), "false_color"))
on_px("tone_pbr_neutral", f"""
WITH {_HDR}, o AS (SELECT *, CASE WHEN least(r, g, b) < 0.08 THEN least(r, g, b) - least(r, g, b) * least(r, g, b) * 6.25 ELSE 0.04 END AS low FROM hdr),
s AS (SELECT img, y, x, a, r - low AS r, g - low AS g, b - low AS b, greatest(r - low, g - low, b - low) AS peak FROM o),
q AS (SELECT *, 1.0 - 0.24::DOUBLE * 0.24 / (peak + 0.24 - 0.76) AS np FROM s),
m AS (SELECT *, 1.0 - 1.0 / ((peak - np) * 0.15 + 1.0) AS mix FROM q),
c AS (SELECT img, y, x, a, {', '.join(f"{_clamp(f'CASE WHEN peak < 0.76 THEN {c} ELSE {c} * (np / peak) * (1.0 - mix) + np * mix END')} AS {c}" for c in 'rgb')} FROM m)
SELECT img, y, x, {', '.join(_eight(_oetf(c), c) for c in 'rgb')}, {_ALPHA} FROM c""", lambda p: tonemap.tonemap(_hdr(p), "pbr_neutral"))


# The operators over ICtCp, as chains of relations that each add some values


def _chain(first: str, *steps: dict[str, str]) -> str:
    return ", ".join(f"s{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {f's{k - 1}' if k else first})" for k, step in enumerate(steps))


def _times(matrix: tuple, c: list[str]) -> list[str]:
    return [f"({c[0]} * {row[0]!r}::DOUBLE + {c[1]} * {row[1]!r}::DOUBLE + {c[2]} * {row[2]!r}::DOUBLE)" for row in matrix]


def _three(name: str, values: list[str]) -> dict[str, str]:
    return {f"{name}{k}": v for k, v in enumerate(values)}


def _pq_power(v: str) -> str:
    return f"pow(abs(({v}) / 10000.0::DOUBLE), {tonemap.PQ_N!r}::DOUBLE)"


def _pq_value(y: str) -> str:
    return f"pow(abs(({y} * {tonemap.PQ_C2!r}::DOUBLE + {tonemap.PQ_C1!r}::DOUBLE) / ({y} * {tonemap.PQ_C3!r}::DOUBLE + 1.0)), {tonemap.PQ_M!r}::DOUBLE)"


def _pq_root(v: str) -> str:
    return f"pow(abs({v}), {1 / tonemap.PQ_M!r}::DOUBLE)"


def _pq_nits(y: str) -> str:
    return f"(pow(abs(greatest({y} - {tonemap.PQ_C1!r}::DOUBLE, 0.0::DOUBLE) / ({tonemap.PQ_C2!r}::DOUBLE - {y} * {tonemap.PQ_C3!r}::DOUBLE)), {1 / tonemap.PQ_N!r}::DOUBLE) * 10000.0::DOUBLE)"


_LMS, _CODE, _ITP, _BACK = ["l0", "l1", "l2"], ["q0", "q1", "q2"], ["i", "t", "p"], ["n0", "n1", "n2"]
_INTO_ICTCP = [
    _three("e", _times(tonemap.TO_2020, ["c0", "c1", "c2"])), _three("l", _times(tonemap.TO_LMS, ["e0", "e1", "e2"])),
    _three("w", [_pq_power(f"greatest({v}, 0.0::DOUBLE)") for v in _LMS]), _three("q", [_pq_value(f"w{k}") for k in range(3)]), dict(zip(_ITP, _times(tonemap.TO_ICTCP, _CODE))),
]
_OUT_OF_ICTCP = [
    {"o0": "lum", "o1": "t * chroma", "o2": "p * chroma"}, _three("b", _times(tonemap.FROM_ICTCP, ["o0", "o1", "o2"])), _three("z", [_pq_root(f"b{k}") for k in range(3)]),
    _three("n", [_pq_nits(f"z{k}") for k in range(3)]), _three("h", _times(tonemap.FROM_LMS, _BACK)),
    {f"f{c}": _clamp(f"{v} / 100.0::DOUBLE") for c, v in zip("rgb", _times(tonemap.TO_709, ["h0", "h1", "h2"]))},
]


def _roll_off(top: float, white: float) -> str:
    """The BT.2390 curve of i, whose knee and width are numbers."""
    knee = 1.5 * white - 0.5 * top
    width = top - knee
    t = f"((i - {knee!r}::DOUBLE) / {width!r}::DOUBLE)"
    cube, square = f"{t} * {t} * {t}", f"{t} * {t}"
    bent = f"({cube} * 2.0 - {square} * 3.0 + 1.0) * {knee!r}::DOUBLE + ({cube} - {square} * 2.0 + {t}) * {width!r}::DOUBLE + ({square} * 3.0 - {cube} * 2.0) * {white!r}::DOUBLE"
    return f"CASE WHEN i < {knee!r}::DOUBLE THEN i ELSE {bent} END"


def _pq_of(nits: float) -> float:
    y = (nits / 10000.0) ** tonemap.PQ_N
    return ((tonemap.PQ_C1 + tonemap.PQ_C2 * y) / (1 + tonemap.PQ_C3 * y)) ** tonemap.PQ_M


_TOP, _WHITE = _pq_of(1000.0), _pq_of(100.0)
_RATIO = "CASE WHEN i > 1e-5 THEN lum / i ELSE 1.0::DOUBLE END"
_TONES = {
    "aces2": [
        {f"c{k}": f"{c} * 100.0::DOUBLE" for k, c in enumerate("rgb")}, *_INTO_ICTCP, {"iy": _pq_root("i")}, {"linear": f"{_pq_nits('iy')} / 100.0::DOUBLE"},
        {"f": "pow(greatest(linear, 0.0::DOUBLE) / (linear + 0.9078), 1.15::DOUBLE) * 1.0470"}, {"m": "greatest(f * f / (f + 0.04), 0.0::DOUBLE)"},
        {"chroma": _clamp("1.1 - m * sqrt(m) * 1.1"), "mw": _pq_power("m * 100.0::DOUBLE")}, {"lum": _pq_value("mw")}, *_OUT_OF_ICTCP,
    ],
    "bt2446c": [
        {f"c{k}": f"greatest({c} * 100.0::DOUBLE, 0.0::DOUBLE)" for k, c in enumerate("rgb")}, *_INTO_ICTCP, {"lum": _roll_off(_TOP, _WHITE)},
        {"v": _clamp(f"lum / {_WHITE!r}::DOUBLE")}, {"chroma": f"({_RATIO}) * 1.15 * (1.0 - {_smooth(0.9, 1.0)})"}, *_OUT_OF_ICTCP,
    ],
    "lumina": [
        {f"p{k}": f"greatest({c}, 0.0::DOUBLE)" for k, c in enumerate("rgb")}, {"least_of": "least(p0, p1, p2)"}, {"low": "CASE WHEN least_of < 0.08 THEN least_of - least_of * least_of * 6.25 ELSE 0.04 END"},
        {f"c{k}": f"greatest(p{k} - low, 0.0::DOUBLE) * 100.0::DOUBLE" for k in range(3)}, *_INTO_ICTCP, {"level": _clamp(f"({_roll_off(_TOP, _WHITE)}) / {_WHITE!r}::DOUBLE")},
        {"lum": f"(level + (level - 0.5) * level * (1.0 - level) * 0.5) * {_WHITE!r}::DOUBLE"}, {"chroma": f"({_RATIO}) * (1.0 / (greatest(i - lum, 0.0::DOUBLE) * 0.15 + 1.0))"}, *_OUT_OF_ICTCP,
    ],
}
for _name, _steps in _TONES.items():
    on_px(f"tone_{_name}", f"WITH {_HDR}, {_chain('hdr', *_steps)} SELECT img, y, x, {', '.join(_eight(_oetf(f'f{c}'), c) for c in 'rgb')}, {_ALPHA} FROM s{len(_steps) - 1}",
          lambda p, n=_name: tonemap.tonemap(_hdr(p), n))
