"""Stand-in catalogues over the test tables: the operators' input where no packed assets are at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: part.p_type to a format code; all other types are BC5.
TYPES = {"ECONOMY": 0, "PROMO": 1, "LARGE": 4, "MEDIUM": 6, "STANDARD": 5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tex_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, ordinal, name, data_size, sha: one texture per document, with its text as payload."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.col("lang"), F.lit("_"), (F.col("n_chars") % 64).cast("string"))
    return d.select(F.col("source").alias("archive"), F.col("doc_id").alias("ordinal"), name.alias("name"), F.octet_length("text").cast("long").alias("data_size"), F.sha2("text", 256).alias("sha"))


def tex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, ordinal, name, format, width, height, mips: one texture per part."""
    p = read(spark, sf_dir, "part")
    kind = F.upper(F.regexp_extract("p_type", "^([A-Za-z]+)", 1))
    fmt = F.lit(3)
    for name, code in TYPES.items():
        fmt = F.when(kind == name, code).otherwise(fmt)
    key = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("archive"),
        key.alias("ordinal"),
        F.col("p_name").alias("name"),
        fmt.cast("int").alias("format"),
        (16 * (1 + F.col("p_size"))).cast("int").alias("width"),
        (16 * (1 + key % 32)).cast("int").alias("height"),
        (1 + key % 5).cast("int").alias("mips"),
    )


def sized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tex_parts with data_size."""
    from granary.functions import texture as T

    return tex_parts(spark, sf_dir).withColumn("data_size", T.total_mip_bytes(F.col("width"), F.col("height"), F.col("format"), F.col("mips")))


def archives_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, parent, is_group: regions as groups, nations as their archives."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    groups = r.select(F.col("r_name").alias("archive"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_group"))
    return groups.unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("archive"), F.col("r_name").alias("parent"), F.lit(False).alias("is_group")))


def tex_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, ordinal, name, data_size: one texture per customer, in the archive of its nation."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("archive"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"), (F.col("c_custkey") * 37 % 1000 + 1).alias("data_size"))


#: DuckDB SQL of the same catalogues.
SQL = {
    "tex_docs": "tex_docs AS (SELECT source AS archive, doc_id AS ordinal, lang || '_' || (n_chars % 64) AS name, CAST(strlen(text) AS BIGINT) AS data_size, sha256(text) AS sha FROM documents)",
    "tex_parts": """tex_parts AS (SELECT p_brand AS archive, p_partkey AS ordinal, p_name AS name,
      CAST(CASE upper(regexp_extract(p_type, '^([A-Za-z]+)', 1)) WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 4 WHEN 'MEDIUM' THEN 6 WHEN 'STANDARD' THEN 5 ELSE 3 END AS INTEGER) AS format,
      CAST(16 * (1 + p_size) AS INTEGER) AS width, CAST(16 * (1 + p_partkey % 32) AS INTEGER) AS height, CAST(1 + p_partkey % 5 AS INTEGER) AS mips FROM part)""",
    "format_dim": """format_dim(code, fname, compressed, bb, pb, dx9, dxgi, wtd) AS (VALUES
      (0, 'D3DFMT_DXT1', true, 8, 0, 827611204, 71, 827611204), (1, 'D3DFMT_DXT5', true, 16, 0, 894720068, 77, 894720068),
      (2, 'D3DFMT_ATI1', true, 8, 0, 826889281, 80, 826889281), (3, 'D3DFMT_ATI2', true, 16, 0, 843666497, 83, 843666497),
      (4, 'D3DFMT_BC7', true, 16, 0, 540492610, 98, 0), (5, 'D3DFMT_A8R8G8B8', false, 0, 4, 21, 87, 21),
      (6, 'D3DFMT_DXT3', true, 16, 0, 861165636, 74, 861165636), (10, 'R8G8B8A8', false, 0, 4, 0, 28, 0),
      (11, 'D3DFMT_R5G6B5', false, 0, 2, 23, 85, 23), (12, 'D3DFMT_A1R5G5B5', false, 0, 2, 25, 86, 25),
      (20, 'D3DFMT_L8', false, 0, 1, 50, 61, 50), (21, 'D3DFMT_A8', false, 0, 1, 28, 65, 28))""",
    "chain": """chain AS (SELECT t.*, CAST(l AS INTEGER) AS level, greatest(1, width >> CAST(l AS INTEGER)) AS w, greatest(1, height >> CAST(l AS INTEGER)) AS h
      FROM (SELECT *, unnest(range(0, mips)) AS l FROM tex_parts) t)""",
    "level_bytes": """level_bytes AS (SELECT c.*, CASE WHEN compressed THEN CAST((w + 3) // 4 AS BIGINT) * ((h + 3) // 4) * bb ELSE CAST(w AS BIGINT) * h * pb END AS bytes
      FROM chain c JOIN format_dim f ON c.format = f.code)""",
    "sized": """sized AS (SELECT archive, ordinal, name, format, width, height, mips, CAST(sum(bytes) AS BIGINT) AS data_size FROM level_bytes GROUP BY ALL)""",
    "archives": """archives AS (SELECT r_name AS archive, CAST(NULL AS VARCHAR) AS parent, true AS is_group FROM region
      UNION ALL SELECT n_name, r_name, false FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "tex_customers": """tex_customers AS (SELECT n_name AS archive, c_custkey AS ordinal, c_name AS name, c_custkey * 37 % 1000 + 1 AS data_size FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
}
PARTS = ("tex_parts", "format_dim", "chain", "level_bytes", "sized")


def sql(views: tuple[str, ...] | list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[v] if v in SQL else v for v in views) + "\n" + body
