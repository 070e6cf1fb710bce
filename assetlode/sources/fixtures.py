"""The catalog relations of the engine, bound to the driver's tables.

Each relation exists as a Spark DataFrame and as SQL text for the oracle, which
prepends it as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ASSETS_SQL = """
SELECT CAST(p_partkey AS BIGINT) AS asset_id,
  concat('/', lower(replace(p_brand,'#','')), '/', CASE WHEN p_partkey % 17 = 0 THEN 'Cache' ELSE lower(p_type) END, '/',
    replace(p_name,' ','_'), CASE p_partkey % 7 WHEN 0 THEN '_norm' WHEN 1 THEN '_rough' WHEN 2 THEN '_orm' ELSE '' END,
    '_', p_partkey, '.', CASE p_type WHEN 'ECONOMY' THEN 'png' WHEN 'LARGE' THEN 'dds' WHEN 'MEDIUM' THEN 'TGA'
      WHEN 'PROMO' THEN 'ktx2' WHEN 'SMALL' THEN 'exr' ELSE 'uasset' END) AS path,
  CAST(round(p_retailprice*10) AS BIGINT) * p_size * (p_partkey % 4) AS file_size,
  CAST(1700000000 + p_partkey*60 AS BIGINT) AS mtime,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size*16 AS BIGINT) ELSE CAST(pow(2, p_partkey % 10 + 4) AS BIGINT) END AS width,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size*12 AS BIGINT) ELSE CAST(pow(2, p_size % 10 + 4) AS BIGINT) END AS height,
  CASE p_partkey % 10 WHEN 0 THEN 'BC1 (DXT1)' WHEN 1 THEN 'BC3 (DXT5)' WHEN 2 THEN 'BC5 (ATI2)' WHEN 3 THEN 'BC7 sRGB'
    WHEN 4 THEN 'Uncompressed' WHEN 5 THEN 'RGBA8 UNORM' WHEN 6 THEN 'RGBA16 Float' WHEN 7 THEN 'PNG'
    WHEN 8 THEN 'BC6H (UF16)' ELSE 'KTX2 (Zstandard)' END AS compression_format,
  CASE WHEN p_size % 3 = 0 THEN 'Linear' ELSE 'sRGB' END AS color_space,
  p_partkey % 2 = 0 AS has_alpha,
  CAST(CASE p_size % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 ELSE 8 END AS BIGINT) AS bit_depth,
  CAST(p_partkey % 11 AS BIGINT) AS mipmap_count,
  p_partkey % 13 = 0 AS is_cubemap
FROM part
"""

FOLDER_SQL = """
SELECT concat('/{folder}/', lower(replace(p_brand,'#','')), '/', p_partkey, '/', replace(p_name,' ','_'), '.', CASE WHEN p_partkey % 3 = 0 THEN 'png' ELSE 'dds' END) AS path, a.*
FROM (SELECT asset_id, file_size, width, height, compression_format, color_space, has_alpha FROM assets) a
JOIN part p ON p.p_partkey = a.asset_id WHERE p_partkey % 8 = {remainder}
"""

FILES_SQL = """
SELECT doc_id AS file_id, concat('/', source, '/', lang, '/doc_', doc_id, '.txt') AS path, n_chars AS file_size, md5(text) AS content_hash FROM documents
"""

_CHANNEL = "CAST(least(255,greatest(0,floor((CAST(e[4*x+{k}] AS DOUBLE)+0.53)*240))) AS BIGINT) AS {name}"
_PX = """
SELECT CAST(img AS BIGINT) img, CAST(y AS BIGINT) y, CAST(x AS BIGINT) x, {channels}
FROM (SELECT img, y, {spread} AS x, e FROM
  (SELECT label AS img, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding e FROM embeddings) b) t
"""


def _px(spread: str, first: int) -> str:
    channels = ", ".join(_CHANNEL.format(k=k + first, name=n) for k, n in enumerate("rgba"))
    return _PX.format(spread=spread, channels=channels)


PX_SPARK, PX_ORACLE = _px("explode(sequence(0,15))", 0), _px("unnest(range(16))", 1)

DHASH_SPARK = """
SELECT vec_id, label, aggregate(sequence(0, 62), 0L, (acc, i) -> acc + IF(embedding[i] > embedding[i + 1], shiftleft(1L, i), 0L)) AS h FROM embeddings
"""
DHASH_ORACLE = """
SELECT vec_id, label, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > embedding[i + 2] THEN CAST(pow(2, i) AS BIGINT) ELSE 0 END)) AS BIGINT) AS h FROM embeddings
"""

#: Common table expressions for the oracle, in the order in which they may use one another.
ORACLE_RELATIONS = {
    "assets": ASSETS_SQL,
    "folder_a": FOLDER_SQL.format(folder="A", remainder=2),
    "folder_b": FOLDER_SQL.format(folder="B", remainder=7),
    "files": FILES_SQL,
    "px": PX_ORACLE,
    "dhash": DHASH_ORACLE,
}
_NEEDS = {"folder_a": ["assets"], "folder_b": ["assets"]}


def oracle(sql: str, *relations: str) -> str:
    """``sql`` with the relations that it names before it; ``sql`` may start with further expressions."""
    wanted = {n for r in relations for n in [*_NEEDS.get(r, []), r]}
    head = ",\n".join(f"{n} AS ({body})" for n, body in ORACLE_RELATIONS.items() if n in wanted)
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{sql[15:]}" if head else sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {head},\n{sql[5:]}" if head else sql
    return f"WITH {head}\n{sql}" if head else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset with its technical metadata."""
    return spark.sql(ASSETS_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def folder(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The assets of one of two folders that are compared."""
    sql = FOLDER_SQL.format(folder=name, remainder={"A": 2, "B": 7}[name])
    sql = sql.replace("FROM assets)", "FROM {assets})").replace("JOIN part p", "JOIN {part} p")
    return spark.sql(sql, assets=assets(spark, sf_dir), part=table(spark, sf_dir, "part"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a content hash."""
    return spark.sql(FILES_SQL.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters, a row for each pixel."""
    return spark.sql(PX_SPARK.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf_dir, "embeddings"))


def dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 63-bit difference fingerprint for each vector."""
    return spark.sql(DHASH_SPARK.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf_dir, "embeddings"))
