"""Queries over the stand-in catalogues, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import paths
from granary.functions import texture as T
from granary.functions.formats import format_dim
from granary.operators import catalog, consolidate, dedup, edits, naming, optimise
from granary.operators.tables import ranked
from granary.plans.standins import PARTS, archives_of_nations, read, sized_parts, sql, tex_customers, tex_docs, tex_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# Duplicates: groups, members, strategies, bins, commit -----------------------------------------------------------

#: The stand-in's names are ASCII, so that bytes are characters; other names are in the tests.
_NAME_KEY = "substr(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1, 64)"
KEYS = {"name": _NAME_KEY, "hash": "sha", "name_hash": f"{_NAME_KEY} || '|' || sha"}


def _keyed(criterion: str) -> str:
    return f"keyed AS (SELECT *, {KEYS[criterion]} AS dup_key FROM tex_docs WHERE {KEYS[criterion]} IS NOT NULL)"


def _ranked(criterion: str) -> list[str]:
    return ["tex_docs", _keyed(criterion), "ranked AS (SELECT *, row_number() OVER (PARTITION BY dup_key ORDER BY archive, ordinal) AS rn, count(*) OVER (PARTITION BY dup_key) AS members FROM keyed)", "dup AS (SELECT * FROM ranked WHERE members > 1)"]


for _criterion in KEYS:
    query(f"dup_by_{_criterion}", sql(_ranked(_criterion), "SELECT dup_key, count(*) AS members, count(DISTINCT sha) AS distinct_payloads, max(archive) FILTER (WHERE rn = 1) AS first_archive, max(ordinal) FILTER (WHERE rn = 1) AS first_ordinal, max(data_size) FILTER (WHERE rn = 1) AS master_size, CAST(sum(data_size) AS BIGINT) AS total_bytes, CAST(sum(data_size) - max(data_size) FILTER (WHERE rn = 1) AS BIGINT) AS wasted_bytes FROM dup GROUP BY dup_key"))(
        lambda spark, d, criterion=_criterion: dedup.groups(tex_docs(spark, d), criterion)
    )


@query("dup_members", sql(_ranked("hash"), "SELECT dup_key, archive, ordinal, members, rn = 1 AS is_master FROM dup"))
def dup_members(spark, d):
    return dedup.members(tex_docs(spark, d), "hash").select("dup_key", "archive", "ordinal", "members", "is_master")


@query(
    "dup_null_payload_excluded",
    sql(["tex_docs", "holed AS (SELECT archive, ordinal, name, data_size, CASE WHEN ordinal % 7 = 0 THEN NULL ELSE sha END AS sha FROM tex_docs)"], "SELECT sha AS dup_key, count(*) AS members FROM holed WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1"),
)
def dup_null_payload_excluded(spark, d):
    holed = tex_docs(spark, d).withColumn("sha", F.when(c("ordinal") % 7 != 0, c("sha")))
    return dedup.groups(holed, "hash").select("dup_key", "members")


@query("migrate_mixed_copies", sql(_ranked("hash"), "SELECT dup_key, archive, ordinal, name, data_size FROM dup WHERE rn = 1"))
def migrate_mixed_copies(spark, d):
    return dedup.copies(tex_docs(spark, d), "hash", "mixed")


@query("migrate_mixed_removals", sql(_ranked("hash"), "SELECT dup_key, archive, ordinal FROM dup WHERE rn > 1"))
def migrate_mixed_removals(spark, d):
    return dedup.removals(tex_docs(spark, d), "hash", "mixed")


_COPIES = "copies AS (SELECT dup_key, archive, ordinal, name, data_size FROM (SELECT *, row_number() OVER (PARTITION BY dup_key, lower(name) ORDER BY archive, ordinal) AS k FROM dup) WHERE k = 1)"


@query("migrate_remove_dups_copies", sql([*_ranked("hash"), _COPIES], "SELECT * FROM copies"))
def migrate_remove_dups_copies(spark, d):
    return dedup.copies(tex_docs(spark, d), "hash", "remove")


@query("migrate_remove_dups_removals", sql(_ranked("hash"), "SELECT dup_key, archive, ordinal FROM dup"))
def migrate_remove_dups_removals(spark, d):
    return dedup.removals(tex_docs(spark, d), "hash", "remove")


#: A small limit, so that small tables fill several bins.
BIN_LIMIT = 16 * 1024
_BINS = [
    *_ranked("hash"),
    "masters AS (SELECT dup_key, archive, ordinal, data_size FROM dup WHERE rn = 1)",
    "ordered AS (SELECT *, row_number() OVER (ORDER BY archive, ordinal) AS i FROM masters)",
    f"""fit AS (SELECT i, CAST(1 AS BIGINT) AS bin, data_size AS fill FROM ordered WHERE i = 1
  UNION ALL SELECT o.i, CASE WHEN f.fill + o.data_size > {BIN_LIMIT} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.fill + o.data_size > {BIN_LIMIT} THEN o.data_size ELSE f.fill + o.data_size END
  FROM fit f JOIN ordered o ON o.i = f.i + 1)""",
    "binned AS (SELECT dup_key, archive, ordinal, data_size, bin FROM ordered JOIN fit USING (i))",
]


def _binned(spark, d):
    return consolidate.bins(dedup.copies(tex_docs(spark, d), "hash", "mixed"), BIN_LIMIT)


@query("consolidation_bins", sql(_BINS, "SELECT * FROM binned", recursive=True))
def consolidation_bins(spark, d):
    return _binned(spark, d).select("dup_key", "archive", "ordinal", "data_size", "bin")


@query("consolidation_summary", sql(_BINS, "SELECT bin, count(*) AS textures, CAST(sum(data_size) AS BIGINT) AS bytes, 'consolidated_textures_' || bin || '.ytd' AS file_name FROM binned GROUP BY bin", recursive=True))
def consolidation_summary(spark, d):
    return consolidate.summary(_binned(spark, d))


@query("consolidation_paths", sql(_BINS, "SELECT bin, count(*) AS textures, CAST(sum(data_size) AS BIGINT) AS bytes, (SELECT 'in/' || min(source) || '/' FROM documents) || 'consolidated_textures_' || bin || '.ytd' AS file_name FROM binned GROUP BY bin", recursive=True))
def consolidation_paths(spark, d):
    archives = read(spark, d, "documents").select(c("source").alias("archive"), F.concat(F.lit("in/"), c("source"), F.lit("/a.ytd")).alias("path")).distinct()
    return consolidate.summary(_binned(spark, d), archives)


@query("migrate_commit_textures", sql(_ranked("hash"), "SELECT archive, ordinal, name, sha FROM tex_docs t WHERE NOT EXISTS (SELECT 1 FROM dup x WHERE x.rn > 1 AND x.archive = t.archive AND x.ordinal = t.ordinal)"))
def migrate_commit_textures(spark, d):
    t = tex_docs(spark, d)
    return dedup.commit(t, dedup.removals(t, "hash", "mixed")).select("archive", "ordinal", "name", "sha")


_PLACED = [
    "ordered AS (SELECT c.*, row_number() OVER (ORDER BY g.archive, g.ordinal, c.archive, c.ordinal) AS i FROM copies c JOIN (SELECT dup_key, archive, ordinal FROM dup WHERE rn = 1) g USING (dup_key))",
    _BINS[-2],
    "placed AS (SELECT o.archive, o.ordinal, bin, row_number() OVER (PARTITION BY bin ORDER BY i) - 1 AS place FROM ordered o JOIN fit USING (i))",
]
for _strategy, _which, _first in (("mixed", "rn > 1", "copies AS (SELECT dup_key, archive, ordinal, name, data_size FROM dup WHERE rn = 1)"), ("remove", "true", _COPIES)):

    def _commit_full(spark, d, strategy=_strategy):
        t = tex_docs(spark, d)
        binned = consolidate.bins(dedup.copies(t, "hash", strategy), BIN_LIMIT)
        return dedup.committed(t, dedup.removals(t, "hash", strategy), binned).select("archive", "ordinal", "name", "data_size", "sha")

    query(
        f"migrate_commit_full_{_strategy}",
        sql(
            [*_ranked("hash"), _first, *_PLACED],
            f"""SELECT archive, ordinal, name, data_size, sha FROM tex_docs t WHERE NOT EXISTS (SELECT 1 FROM dup x WHERE {_which} AND x.archive = t.archive AND x.ordinal = t.ordinal)
  UNION ALL SELECT 'consolidated_textures_' || bin || '.ytd', place, name, data_size, sha FROM placed JOIN tex_docs USING (archive, ordinal)""",
            recursive=True,
        ),
    )(_commit_full)


@query("migrate_keep_originals", sql(_BINS, "SELECT dup_key, archive, ordinal FROM dup WHERE rn > 1 AND dup_key NOT IN (SELECT dup_key FROM binned WHERE bin IN (1, 3))", recursive=True))
def migrate_keep_originals(spark, d):
    return dedup.kept_back(dedup.removals(tex_docs(spark, d), "hash", "mixed"), _binned(spark, d), (1, 3))


@query("migrate_summary", sql(_BINS, "SELECT (SELECT count(*) FROM masters) AS groups, (SELECT count(*) FROM dup WHERE rn > 1) AS to_move, (SELECT max(bin) FROM binned) AS consolidated", recursive=True))
def migrate_summary(spark, d):
    t = tex_docs(spark, d)
    found = dedup.groups(t, "hash").agg(F.count("*").alias("groups"), F.coalesce(F.sum(c("members") - 1), F.lit(0)).alias("to_move"))
    return found.crossJoin(_binned(spark, d).agg(F.max("bin").alias("consolidated")))  # one row each


@query("distinct_sources", "SELECT lower(source) AS source_key, min(source) AS source_path, count(*) AS entries FROM documents WHERE source IS NOT NULL GROUP BY 1")
def distinct_sources(spark, d):
    return dedup.distinct_sources(read(spark, d, "documents").select(c("source").alias("source_path")))


@query("alias_blocks", sql(["tex_parts"], "SELECT archive, ordinal, CAST(width * 16 AS BIGINT) AS data_off, count(*) OVER (PARTITION BY archive, width) > 1 AS aliased FROM tex_parts"))
def alias_blocks(spark, d):
    return dedup.aliases(tex_parts(spark, d).select("archive", "ordinal", (c("width").cast("long") * 16).alias("data_off")))


# Roll-ups, totals, sorts, search ---------------------------------------------------------------------------------

_ROLLED = "rolled AS (SELECT archive, count(*) AS textures, CAST(sum(data_size) AS BIGINT) AS total_bytes, max(CAST(width AS BIGINT) * height) AS max_pixels, max(mips) AS max_mips, arg_max(struct_pack(o := ordinal, n := name, f := format), struct_pack(p := CAST(width AS BIGINT) * height, o := -ordinal)) AS b FROM sized GROUP BY archive)"


@query("archive_rollup", sql([*PARTS, _ROLLED], "SELECT archive, textures, total_bytes, max_pixels, max_mips, b.o AS largest_ordinal, b.n AS largest_name, b.f AS primary_format FROM rolled"))
def archive_rollup(spark, d):
    return catalog.archive_rollup(sized_parts(spark, d))


@query("archive_primary_format", sql([*PARTS, _ROLLED], "SELECT archive, fname AS format_name, replace(fname, 'D3DFMT_', '') AS short_name FROM rolled JOIN format_dim ON b.f = code"))
def archive_primary_format(spark, d):
    r = catalog.archive_rollup(sized_parts(spark, d))
    return r.select("archive", T.format_name(c("primary_format")).alias("format_name"), T.short_format_name(c("primary_format")).alias("short_name"))


_CUSTOMER_ROLL = "rolled AS (SELECT archive, count(*) AS textures, CAST(sum(data_size) AS BIGINT) AS total_bytes FROM tex_customers GROUP BY archive)"


def _customer_roll(spark, d):
    return tex_customers(spark, d).groupBy("archive").agg(F.count("*").alias("textures"), F.sum("data_size").alias("total_bytes"))


@query("group_rollup", sql(["archives", "tex_customers", _CUSTOMER_ROLL], "SELECT parent, count(*) AS children, CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS total_bytes FROM archives LEFT JOIN rolled USING (archive) WHERE parent IS NOT NULL GROUP BY parent"))
def group_rollup(spark, d):
    return catalog.group_rollup(archives_of_nations(spark, d), _customer_roll(spark, d))


@query("workspace_totals", sql(["archives", "tex_customers", _CUSTOMER_ROLL], "SELECT count(*) FILTER (WHERE parent IS NULL) AS files, CAST(coalesce(sum(textures) FILTER (WHERE NOT is_group), 0) AS BIGINT) AS resources, CAST(coalesce(sum(total_bytes) FILTER (WHERE NOT is_group), 0) AS BIGINT) AS bytes FROM archives LEFT JOIN rolled USING (archive)"))
def workspace_totals(spark, d):
    return catalog.workspace_totals(archives_of_nations(spark, d), _customer_roll(spark, d))


_STATUS = "CASE event_id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'encrypted' ELSE 'ok' END"


@query("scan_counters", f"SELECT count(*) AS candidates, count(*) FILTER (WHERE s = 'ok') AS loaded, count(*) FILTER (WHERE s = 'rejected') AS rejected, count(*) FILTER (WHERE s = 'unavailable') AS unavailable, count(*) FILTER (WHERE s = 'encrypted') AS encrypted FROM (SELECT {_STATUS} AS s FROM events)")
def scan_counters(spark, d):
    return catalog.scan_counters(read(spark, d, "events").select(F.expr(_STATUS).alias("status")))


_ARCHIVES = "listed AS (SELECT r.archive, r.archive AS name, '.' || lower(substr(r.archive, 1, 3)) AS ext, textures, total_bytes, max_pixels, max_mips, fname AS format_name, CAST(textures % 7 AS BIGINT) AS modified FROM rolled r JOIN format_dim ON b.f = code)"
_ARCHIVE_ORDER = {"name": "name", "type": "ext", "size": "total_bytes DESC", "count": "textures DESC", "resolution": "max_pixels DESC, name", "mipmaps": "max_mips DESC, name", "compression": "format_name, name", "modified": "modified DESC"}


def _listed(spark, d):
    r = catalog.archive_rollup(sized_parts(spark, d))
    return r.select("archive", c("archive").alias("name"), F.concat(F.lit("."), F.lower(F.substring("archive", 1, 3))).alias("ext"), "textures", "total_bytes", "max_pixels", "max_mips", T.format_name(c("primary_format")).alias("format_name"), (c("textures") % 7).alias("modified"))


for _mode, _by in _ARCHIVE_ORDER.items():

    def _sorted_archives(spark, d, mode=_mode):
        return ranked(_listed(spark, d), [], catalog._order(catalog.ARCHIVE_MODES[mode], ["archive"])).select("archive", "rank")

    query(f"sort_archives_{_mode}", sql([*PARTS, _ROLLED, _ARCHIVES], f"SELECT archive, CAST(row_number() OVER (ORDER BY {_by}, archive) AS INTEGER) AS rank FROM listed"))(_sorted_archives)

_TEXTURE_ORDER = {"size": "data_size DESC, name", "resolution": "CAST(width AS BIGINT) * height DESC, width DESC, height DESC, name", "mipmaps": "mips DESC, name", "compression": "fname, name"}
for _mode, _by in _TEXTURE_ORDER.items():

    def _sorted_textures(spark, d, mode=_mode):
        rows = sized_parts(spark, d).withColumn("pixels", c("width").cast("long") * c("height")).withColumn("format_name", T.format_name(c("format")))
        return ranked(rows, ["archive"], catalog._order(catalog.TEXTURE_MODES[mode], ["ordinal"])).select("archive", "ordinal", "rank")

    query(f"sort_textures_{_mode}", sql(PARTS, f"SELECT archive, ordinal, CAST(row_number() OVER (PARTITION BY archive ORDER BY {_by}, ordinal) AS INTEGER) AS rank FROM sized JOIN format_dim ON format = code"))(_sorted_textures)


@query("archive_limits", "SELECT source AS archive, count(*) AS textures, count(*) <= 4096 AS within_limit FROM documents GROUP BY source")
def archive_limits(spark, d):
    return catalog.beyond_limits(tex_docs(spark, d).groupBy("archive").agg(F.count("*").alias("textures")))


@query("save_validity", sql([*PARTS, "holed AS (SELECT archive, format, CASE WHEN ordinal % 50 = 0 THEN '' ELSE name END AS name, CASE WHEN ordinal % 60 = 0 THEN 0 ELSE data_size END AS data_size FROM sized)", "marked AS (SELECT archive, name = '' OR data_size = 0 OR wtd = 0 AS bad FROM holed JOIN format_dim ON format = code)"], "SELECT archive, count(*) FILTER (WHERE bad) AS invalid, bool_and(NOT bad) AS savable FROM marked GROUP BY archive"))
def save_validity(spark, d):
    rows = sized_parts(spark, d).withColumn("name", F.when(c("ordinal") % 50 == 0, "").otherwise(c("name"))).withColumn("data_size", F.when(c("ordinal") % 60 == 0, 0).otherwise(c("data_size")))
    return catalog.savable(rows, "wtd")


@query("labels_with_fallback", "SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'fr:' || n_name WHEN n_nationkey % 3 = 1 THEN 'en:' || n_name ELSE n_name END AS label FROM nation")
def labels_with_fallback(spark, d):
    n, k = read(spark, d, "nation"), c("n_nationkey")
    given = n.where(k % 3 < 2).select(F.when(k % 3 == 0, "fr").otherwise("en").alias("language"), c("n_name").alias("key"))
    return catalog.labelled(n.select(c("n_name").alias("key")), given.withColumn("label", F.concat("language", F.lit(":"), "key")), "fr")


@query("search_textures", sql(["tex_parts"], "SELECT archive, ordinal, name FROM tex_parts WHERE contains(lower(name), 'ring')"))
def search_textures(spark, d):
    return catalog.search_textures(tex_parts(spark, d), "RING").select("archive", "ordinal", "name")


#: Searches that hit archives by their own name, by a texture in them, and by a child.
_SEARCHES = ("n_2", "#00000012", "asia")


@query(
    "search_archives_exists",
    sql(
        ["archives", "tex_customers", "searches(q) AS (VALUES " + ", ".join(f"('{q}')" for q in _SEARCHES) + ")", "hit AS (SELECT q, archive, parent FROM archives a, searches WHERE contains(lower(archive), q) OR EXISTS (SELECT 1 FROM tex_customers t WHERE t.archive = a.archive AND contains(lower(t.name), q)))"],
        "SELECT q AS query, archive FROM hit UNION SELECT q, parent FROM hit WHERE parent IS NOT NULL",
    ),
)
def search_archives_exists(spark, d):
    a, t = archives_of_nations(spark, d), tex_customers(spark, d)
    found = [catalog.search_archives(a, t, q.upper()).select(F.lit(q).alias("query"), "archive") for q in _SEARCHES]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("visible_rows", sql(["archives", "tex_customers"], "SELECT archive, CAST(NULL AS BIGINT) AS ordinal, archive AS name FROM archives UNION ALL SELECT archive, ordinal, name FROM tex_customers WHERE archive IN (SELECT max(archive) FROM archives WHERE NOT is_group)"))
def visible_rows(spark, d):
    a = archives_of_nations(spark, d)
    last = a.where("NOT is_group").agg(F.max("archive")).first()[0]
    return catalog.visible_rows(a, tex_customers(spark, d), (last,))


_IMPORT_PATH = "CASE doc_id % 6 WHEN 0 THEN source || '/a' || doc_id || '.YTD' WHEN 1 THEN source || '\\b.wtd' WHEN 2 THEN source || '/.hidden.ytd' WHEN 3 THEN 'x/' || doc_id || '.rpf' WHEN 4 THEN source || '/noext' ELSE 'c:d?' || doc_id || '.rpf/in/y.ydr' END"


def _paths(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(_IMPORT_PATH.replace("\\", "\\\\")).alias("path"))


_PATHS = f"paths AS (SELECT doc_id, path, replace(path, '\\', '/') AS p FROM (SELECT doc_id, {_IMPORT_PATH} AS path FROM documents))"
_LEAF = "string_split(p, '/')[-1]"


@query("import_filter", sql([_PATHS], f"SELECT doc_id, path FROM paths WHERE lower(regexp_extract({_LEAF}, '(\\.[^.]*)$', 1)) IN ('.ytd', '.rpf') AND NOT starts_with({_LEAF}, '.')"))
def import_filter(spark, d):
    return catalog.importable(_paths(spark, d), (".ytd", ".rpf"))


@query(
    "path_parts",
    sql(
        [_PATHS],
        f"""SELECT doc_id, {_LEAF} AS leaf, lower(regexp_extract({_LEAF}, '(\\.[^.]*)$', 1)) AS ext, contains(lower(p), '.rpf/') AS nested,
  translate(path, ':*?"<>|', '_______') AS clean, regexp_replace(path, '\\.[^./\\\\]*$', '') || '.ytd' AS renamed,
  CASE lower(regexp_extract({_LEAF}, '(\\.[^.]*)$', 1)) WHEN '.wtd' THEN 'wtd' WHEN '.ydr' THEN 'model' WHEN '.yft' THEN 'model' WHEN '.ydd' THEN 'model' WHEN '.rpf' THEN 'rpf' ELSE 'ytd' END AS loader FROM paths""",
    ),
)
def path_parts(spark, d):
    p = c("path")
    return _paths(spark, d).select("doc_id", paths.leaf(p).alias("leaf"), paths.extension(p).alias("ext"), paths.is_nested(p).alias("nested"), paths.sanitised(p).alias("clean"), paths.renamed(p, ".ytd").alias("renamed"), paths.loader(p).alias("loader"))


@query("url_parts", "SELECT page_id, string_split(url, '/')[-1] AS leaf, translate(url, ':*?\"<>|', '_______') AS clean FROM pages")
def url_parts(spark, d):
    return read(spark, d, "pages").select("page_id", paths.leaf(c("url")).alias("leaf"), paths.sanitised(c("url")).alias("clean"))


@query("export_names", sql(["tex_parts"], "SELECT archive, ordinal, name || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.dds' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY archive, lower(name) ORDER BY ordinal) AS n FROM tex_parts)"))
def export_names(spark, d):
    return naming.export_names(tex_parts(spark, d))


@query("saved_names", "SELECT archive, position, regexp_replace(leaf, '\\.[^.]*$', '') || CASE WHEN n = 1 THEN '' ELSE '-' || n END || CASE WHEN regexp_extract(leaf, '(\\.[^.]*)$', 1) = '' THEN '.ytd' ELSE regexp_extract(leaf, '(\\.[^.]*)$', 1) END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(leaf) ORDER BY position) AS n FROM (SELECT source AS archive, doc_id AS position, lang || CASE WHEN doc_id % 2 = 0 THEN '.wtd' ELSE '' END AS leaf FROM documents))")
def saved_names(spark, d):
    rows = read(spark, d, "documents").select(c("source").alias("archive"), c("doc_id").alias("position"), F.concat(F.lit("in/"), c("lang"), F.when(c("doc_id") % 2 == 0, ".wtd").otherwise("")).alias("path"))
    return naming.saved_names(rows)


_ROUTED = """routed AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 OR doc_id % 3 = 0 OR doc_id % 13 = 0 THEN 'skip' WHEN doc_id % 4 = 0 THEN 'file' WHEN doc_id % 4 = 1 THEN 'sidecar' ELSE 'container' END AS route FROM documents)"""


def _routed(spark, d):
    i = c("doc_id")
    rows = read(spark, d, "documents").select(i, F.when(i % 11 == 0, "group").otherwise("archive").alias("kind"), F.initcap("source").alias("source_path"), F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "a.RPF\\b/c.ytd").otherwise("b/c.ytd").alias("entry_path"), (i % 3 != 0).alias("modified"), (i % 13 == 0).alias("is_preview"))
    return naming.save_route(rows)


@query("save_summary", sql([_ROUTED], "SELECT count(*) FILTER (WHERE route = 'file') AS files, count(*) FILTER (WHERE route = 'container') AS into_containers, count(*) FILTER (WHERE route = 'sidecar') AS sidecars, count(*) FILTER (WHERE route = 'skip') AS skipped FROM routed"))
def save_summary(spark, d):
    return naming.save_summary(_routed(spark, d))


@query("container_rewrites", sql([_ROUTED], "SELECT lower(source) AS source_key, count(*) AS replacements FROM routed WHERE route = 'container' GROUP BY 1"))
def container_rewrites(spark, d):
    return naming.rewrites(_routed(spark, d)).select("source_key", "replacements")


# Sizes, flags, hashes --------------------------------------------------------------------------------------------


def _case(bounds: tuple[float, ...], size: str) -> str:
    mib = f"({size}) / 1048576.0::DOUBLE"
    return "CASE " + " ".join(f"WHEN {mib} {'<' if i == len(bounds) - 1 else '<='} {b}::DOUBLE THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


@query("size_grade_texture", sql(PARTS, f"SELECT archive, ordinal, CAST({_case(T.TEXTURE_GRADES, 'data_size * 8')} AS INTEGER) AS grade, format('{{:.2f}}', (data_size * 8) / 1048576.0::DOUBLE) AS mib FROM sized"))
def size_grade_texture(spark, d):
    size = c("data_size") * 8  # so that all grades occur
    return sized_parts(spark, d).select("archive", "ordinal", T.grade(size, T.TEXTURE_GRADES).cast("int").alias("grade"), T.mib_text(size).alias("mib"))


@query("size_grade_archive", sql([*PARTS, _ROLLED], f"SELECT archive, total_bytes, CAST({_case(T.ARCHIVE_GRADES, 'total_bytes')} AS INTEGER) AS grade FROM rolled"))
def size_grade_archive(spark, d):
    return catalog.archive_rollup(sized_parts(spark, d)).select("archive", "total_bytes", T.grade(c("total_bytes"), T.ARCHIVE_GRADES).cast("int").alias("grade"))


@query("mip_chain", sql(PARTS, "SELECT archive, ordinal, level, w, h, bytes FROM level_bytes"))
def mip_chain(spark, d):
    rows = tex_parts(spark, d).select("archive", "ordinal", "format", F.explode(T.levels(c("width"), c("height"), c("mips"))).alias("l"))
    return rows.select("archive", "ordinal", "l.level", "l.w", "l.h", T.mip_bytes(c("l.w"), c("l.h"), c("format")).alias("bytes"))


@query("total_mip_bytes", sql(PARTS, "SELECT archive, ordinal, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE w >= 16 AND h >= 16), 0) AS BIGINT) AS large_bytes FROM level_bytes GROUP BY archive, ordinal"))
def total_mip_bytes(spark, d):
    args = (c("width"), c("height"), c("format"), c("mips"))
    return tex_parts(spark, d).select("archive", "ordinal", T.total_mip_bytes(*args).alias("total_bytes"), T.large_mip_bytes(*args).alias("large_bytes"))


@query("stride", sql(["tex_parts", "format_dim"], "SELECT archive, ordinal, CAST(CASE WHEN compressed THEN (width + 3) // 4 * bb ELSE width * pb END AS BIGINT) AS row_pitch, CAST(CASE WHEN compressed THEN ((width + 3) // 4 * bb * ((height + 3) // 4)) // height ELSE width * pb END AS BIGINT) AS stride FROM tex_parts JOIN format_dim ON format = code"))
def stride(spark, d):
    return tex_parts(spark, d).select("archive", "ordinal", T.row_pitch(c("width"), c("format")).alias("row_pitch"), T.stride(c("width"), c("height"), c("format")).alias("stride"))


@query("natural_levels", sql(["tex_parts"], "SELECT archive, ordinal, CAST(least(13, length(bin(greatest(width, height)))) AS INTEGER) AS levels FROM tex_parts"))
def natural_levels(spark, d):
    return tex_parts(spark, d).select("archive", "ordinal", T.natural_levels(c("width"), c("height")).cast("int").alias("levels"))


@query("preview_level", sql(["tex_parts"], "SELECT archive, ordinal, CAST(coalesce(list_max(list_filter(range(0, mips), lambda i: greatest(1, greatest(width, height) >> CAST(i AS INTEGER)) >= 128 AND i < length(bin(greatest(width, height))))), 0) AS INTEGER) AS level FROM tex_parts"))
def preview_level(spark, d):
    return tex_parts(spark, d).select("archive", "ordinal", T.preview_level(c("width"), c("height"), c("mips"), 128).cast("int").alias("level"))


_HASH_STEPS = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(name), ''), lambda x: ascii(x)::BIGINT)), lambda h, b: xor(((h + b) & 4294967295) + ((((h + b) & 4294967295) << 10) & 4294967295) & 4294967295, (((h + b) & 4294967295) + ((((h + b) & 4294967295) << 10) & 4294967295) & 4294967295) >> 6))"
_HASH = [f"steps AS (SELECT *, {_HASH_STEPS} AS h0 FROM tex_parts)", "eight AS (SELECT *, xor((h0 + (h0 << 3)) & 4294967295, ((h0 + (h0 << 3)) & 4294967295) >> 11) AS h1 FROM steps)", "hashed AS (SELECT *, (h1 + (h1 << 15)) & 4294967295 AS name_hash FROM eight)"]


@query("name_hash", sql(["tex_parts", *_HASH], "SELECT archive, ordinal, name, name_hash FROM hashed"))
def name_hash(spark, d):
    return tex_parts(spark, d).select("archive", "ordinal", "name", T.name_hash(c("name")).alias("name_hash"))


@query("hash_sorted_dictionary", sql(["tex_parts", *_HASH], "SELECT archive, ordinal, CAST(row_number() OVER w AS INTEGER) AS slot, lag(ordinal) OVER w AS prev, lead(ordinal) OVER w AS next FROM hashed WINDOW w AS (PARTITION BY archive ORDER BY name_hash, ordinal)"))
def hash_sorted_dictionary(spark, d):
    rows = tex_parts(spark, d).select("archive", "ordinal", T.name_hash(c("name")).alias("name_hash"))
    slots = ranked(rows, ["archive"], [F.asc("name_hash"), F.asc("ordinal")], "slot").select("archive", "ordinal", "slot")
    beside = lambda by, name: slots.select("archive", (c("slot") + by).alias("slot"), c("ordinal").alias(name))
    return slots.join(beside(1, "prev"), ["archive", "slot"], "left").join(beside(-1, "next"), ["archive", "slot"], "left").select("archive", "ordinal", "slot", "prev", "next")


@query("payload_sha", "SELECT doc_id, sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS data_size FROM documents")
def payload_sha(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("data_size"))


_FLAGS = "flags AS (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS f, p_partkey * 9973 AS s FROM part)"
_FIELDS = ((27, 1), (26, 1), (25, 1), (24, 1), (17, 127), (11, 63), (7, 15), (5, 3), (4, 1))


def _flags(spark, d):
    p = c("p_partkey")
    return read(spark, d, "part").select(p, (p * 2654435761 % 4294967296).alias("f"), (p * 9973).alias("s"))


@query("rsc7_page_flags", sql([_FLAGS], "SELECT p_partkey, CAST((512 << CAST(f & 15 AS INTEGER)) * (" + " + ".join(f"(((f >> {b}) & {m}) << {k})" for k, (b, m) in enumerate(_FIELDS)) + ") AS BIGINT) AS bytes, " + " + ".join(f"((f >> {b}) & {m})" for b, m in _FIELDS) + " AS pages FROM flags"))
def rsc7_page_flags(spark, d):
    return _flags(spark, d).select("p_partkey", T.page_bytes(c("f")).alias("bytes"), T.page_count(c("f")).alias("pages"))


@query("rsc7_single_page_flags", sql([_FLAGS], "SELECT p_partkey, (13 << 28)::BIGINT + CASE WHEN s = 0 THEN 0 WHEN s <= 16777216 THEN 134217728 + list_min(list_filter(range(0, 16), lambda k: (512 << CAST(k AS INTEGER)) >= s)) ELSE [134217728, 67108864, 33554432, 16777216, 131072, 2048, 128, 32, 16][coalesce(list_min(list_filter(range(0, 9), lambda k: (16777216::BIGINT << CAST(k AS INTEGER)) >= s)), 8) + 1] + 15 END AS flags FROM flags".replace("(13 << 28)::BIGINT", "3489660928")))
def rsc7_single_page_flags(spark, d):
    return _flags(spark, d).select("p_partkey", T.single_page_flags(c("s"), 13).alias("flags"))


@query("rsc5_sizes", sql([_FLAGS], "SELECT p_partkey, (f & 2047) << CAST(((f >> 11) & 15) + 8 AS INTEGER) AS virtual_bytes, ((f >> 15) & 2047) << CAST(((f >> 26) & 15) + 8 AS INTEGER) AS physical_bytes FROM flags"))
def rsc5_sizes(spark, d):
    return _flags(spark, d).select("p_partkey", T.rsc5_virtual_bytes(c("f")).alias("virtual_bytes"), T.rsc5_physical_bytes(c("f")).alias("physical_bytes"))


@query("rsc5_next_size", sql([_FLAGS], "SELECT p_partkey, CASE WHEN s = 0 THEN 256 ELSE (s + u - 1) // u * u END AS padded FROM (SELECT *, 256::BIGINT << CAST(list_min(list_filter(range(0, 16), lambda k: (s + (256::BIGINT << CAST(k AS INTEGER)) - 1) // (256::BIGINT << CAST(k AS INTEGER)) <= 2047)) AS INTEGER) AS u FROM flags)"))
def rsc5_next_size(spark, d):
    return _flags(spark, d).select("p_partkey", T.rsc5_next_size(c("s")).alias("padded"))


@query("rsc5_flags", sql([_FLAGS, "ks AS (SELECT p_partkey, 256 * (p_partkey % 3000) AS v, 4096 * (p_partkey % 777) AS p FROM part)", "pick AS (SELECT *, list_max(list_filter(range(0, 16), lambda k: v % (256 << CAST(k AS INTEGER)) = 0 AND v // (256 << CAST(k AS INTEGER)) <= 2047)) AS a, list_max(list_filter(range(0, 16), lambda k: p % (256 << CAST(k AS INTEGER)) = 0 AND p // (256 << CAST(k AS INTEGER)) <= 2047)) AS b FROM ks)"], "SELECT p_partkey, coalesce(v // (256 << CAST(a AS INTEGER)), 0) + (coalesce(a, 0) << 11) + (coalesce(p // (256 << CAST(b AS INTEGER)), 0) << 15) + (coalesce(b, 0) << 26) AS flags FROM pick"))
def rsc5_flags(spark, d):
    p = c("p_partkey")
    return read(spark, d, "part").select(p, T.rsc5_flags(256 * (p % 3000), 4096 * (p % 777)).alias("flags"))


@query("alignment", sql([_FLAGS], "SELECT p_partkey, (s + 15) // 16 * 16 AS to16, (s + 511) // 512 * 512 AS to512 FROM flags"))
def alignment(spark, d):
    return _flags(spark, d).select("p_partkey", T.aligned(c("s"), 16).alias("to16"), T.aligned(c("s"), 512).alias("to512"))


@query("format_codes", sql(["format_dim"], "SELECT code, fname AS name, CAST(dx9 AS BIGINT) AS dx9, CAST(dxgi AS BIGINT) AS dxgi, CAST(wtd AS BIGINT) AS wtd, compressed, bb AS block_bytes, pb AS pixel_bytes FROM format_dim"))
def format_codes(spark, d):
    f = format_dim(spark)
    code = c("code")
    # through the expressions and back through the table's codes
    out = f.select(code, T.format_name(code).alias("name"), T.dx9_code(code).alias("dx9"), T.dxgi_code(code).alias("dxgi"), T.wtd_code(code).alias("wtd"), T.is_compressed(code).alias("compressed"), T.block_bytes(code).alias("block_bytes"), T.pixel_bytes(code).alias("pixel_bytes"))
    return out.join(f.select(c("dxgi"), c("code").alias("back")), "dxgi").where("back = code").select(*out.columns)


# Plans -----------------------------------------------------------------------------------------------------------

_MAX = 128
_BYTES = lambda w, h, n: f"list_sum(list_transform(range(0, {n}), lambda i: CASE WHEN compressed THEN CAST((greatest(1, {w} >> CAST(i AS INTEGER)) + 3) // 4 AS BIGINT) * ((greatest(1, {h} >> CAST(i AS INTEGER)) + 3) // 4) * {{bb}} ELSE CAST(greatest(1, {w} >> CAST(i AS INTEGER)) AS BIGINT) * greatest(1, {h} >> CAST(i AS INTEGER)) * {{pb}} END))"
_PLAN = [
    *PARTS,
    f"""halved AS (SELECT t.*, compressed, bb, pb, CAST(list_min(list_filter(range(0, 32), lambda k: greatest(1, width >> CAST(k AS INTEGER)) <= {_MAX} AND greatest(1, height >> CAST(k AS INTEGER)) <= {_MAX})) AS INTEGER) AS halvings
  FROM tex_parts t JOIN format_dim ON format = code WHERE width > {_MAX} OR height > {_MAX})""",
    "sides AS (SELECT *, greatest(4, width >> halvings) AS new_width, greatest(4, height >> halvings) AS new_height FROM halved)",
    "leveled AS (SELECT *, least(mips, length(bin(greatest(new_width, new_height)))) AS new_mips FROM sides)",
    f"plan AS (SELECT *, CAST({_BYTES('width', 'height', 'mips').format(bb='bb', pb='pb')} AS BIGINT) AS before_bytes, CAST({_BYTES('new_width', 'new_height', 'new_mips').format(bb='bb', pb='pb')} AS BIGINT) AS after_bytes FROM leveled)",
]
_POLICY = optimise.ResizePolicy(_MAX, _MAX)


@query("smart_resize_plan", sql(_PLAN, "SELECT archive, ordinal, halvings, CAST(new_width AS INTEGER) AS new_width, CAST(new_height AS INTEGER) AS new_height, CAST(new_mips AS INTEGER) AS new_mips, before_bytes, after_bytes FROM plan"))
def smart_resize_plan(spark, d):
    return optimise.resize_plan(tex_parts(spark, d), _POLICY).select("archive", "ordinal", "halvings", "new_width", "new_height", "new_mips", "before_bytes", "after_bytes")


@query("smart_resize_summary", sql(_PLAN, "SELECT archive, count(*) AS resized, CAST(sum(before_bytes) AS BIGINT) AS before_bytes, CAST(sum(after_bytes) AS BIGINT) AS after_bytes FROM plan GROUP BY ROLLUP (archive)"))
def smart_resize_summary(spark, d):
    return optimise.resize_summary(tex_parts(spark, d), _POLICY)


@query("manual_half", sql(["tex_parts"], "SELECT archive, ordinal, CAST(greatest(4, width // 2) AS INTEGER) AS new_width, CAST(greatest(4, height // 2) AS INTEGER) AS new_height, CAST(least(13, length(bin(greatest(4, width // 2, height // 2)))) AS INTEGER) AS new_mips FROM tex_parts"))
def manual_half(spark, d):
    return optimise.manual_plan(tex_parts(spark, d), "half").select("archive", "ordinal", "new_width", "new_height", "new_mips")


_ALPHA = "re AS (SELECT s.*, ordinal % 2 = 0 AS alpha_used, CASE WHEN format IN (1, 4, 6) AND ordinal % 2 <> 0 THEN 0 ELSE format END AS new_format FROM sized s JOIN format_dim ON format = code WHERE compressed AND width >= 4 AND height >= 4)"
_RE = [*PARTS, _ALPHA, f"plan AS (SELECT r.*, data_size AS before_bytes, CAST({_BYTES('width', 'height', 'mips').format(bb='bb', pb='pb')} AS BIGINT) AS after_bytes FROM re r JOIN format_dim ON new_format = code)"]


def _alpha(spark, d):
    return tex_parts(spark, d).withColumn("alpha_used", c("ordinal") % 2 == 0)


@query("recompress_plan", sql(_RE, "SELECT archive, ordinal, new_format, before_bytes, after_bytes FROM plan"))
def recompress_plan(spark, d):
    return optimise.recompress_plan(_alpha(spark, d)).select("archive", "ordinal", "new_format", "before_bytes", "after_bytes")


@query("recompress_savings", sql(_RE, "SELECT count(*) AS processed, count(*) FILTER (WHERE new_format <> format) AS downgraded, CAST(sum(before_bytes) AS BIGINT) AS before_bytes, CAST(sum(after_bytes) AS BIGINT) AS after_bytes, CAST(sum(before_bytes) - sum(after_bytes) AS BIGINT) / 1048576.0::DOUBLE AS saved_mib, CAST(sum(before_bytes) - sum(after_bytes) AS BIGINT) * 100.0::DOUBLE / CAST(sum(before_bytes) AS BIGINT) AS saved_percent FROM plan"))
def recompress_savings(spark, d):
    return optimise.recompress_summary(_alpha(spark, d))


@query("same_format_plan", sql(PARTS, "SELECT archive, ordinal, format AS new_format, mips AS new_mips, data_size AS before_bytes, data_size AS after_bytes FROM sized JOIN format_dim ON format = code WHERE compressed AND width >= 4 AND height >= 4"))
def same_format_plan(spark, d):
    return optimise.same_format_plan(tex_parts(spark, d)).select("archive", "ordinal", "new_format", "new_mips", "before_bytes", "after_bytes")


@query("same_format_summary", sql(["tex_parts", "format_dim"], "SELECT count(*) FILTER (WHERE compressed AND width >= 4 AND height >= 4) AS processed, count(*) FILTER (WHERE NOT (compressed AND width >= 4 AND height >= 4)) AS skipped FROM tex_parts JOIN format_dim ON format = code"))
def same_format_summary(spark, d):
    return optimise.same_format_summary(tex_parts(spark, d))


@query("alpha_in_use", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN false ELSE len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) * 1000 + 400 < 250)) > 0 END AS used FROM embeddings")
def alpha_in_use(spark, d):
    fmt = F.when(c("label") % 2 == 0, 0).otherwise(5)  # BC1 never has alpha here, A8R8G8B8 may
    alphas = F.transform("embedding", lambda x: x.cast("double") * 1000 + 400)
    return read(spark, d, "embeddings").select("vec_id", optimise.alpha_in_use(fmt, alphas).alias("used"))


# Edits -----------------------------------------------------------------------------------------------------------

_EDITS = "edits AS (SELECT archive, ordinal, 1 AS seq, width // 2 AS width, height // 2 AS height, 0 AS format, mips FROM tex_parts WHERE ordinal % 3 = 0 UNION ALL SELECT archive, ordinal, 2, width // 4, height // 4, format, 1 FROM tex_parts WHERE ordinal % 6 = 0), last AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY archive, ordinal ORDER BY seq DESC) = 1)"
_CURRENT = "SELECT t.archive, t.ordinal, t.name, CAST(coalesce(e.width, t.width) AS INTEGER) AS width, CAST(coalesce(e.height, t.height) AS INTEGER) AS height, CAST(coalesce(e.format, t.format) AS INTEGER) AS format, CAST(coalesce(e.mips, t.mips) AS INTEGER) AS mips, t.width AS orig_width, t.height AS orig_height, t.format AS orig_format, t.mips AS orig_mips, e.seq IS NOT NULL AS modified FROM tex_parts t LEFT JOIN last e ON t.archive = e.archive AND t.ordinal = e.ordinal"


def _edits(spark, d):
    t = tex_parts(spark, d)
    one = t.where("ordinal % 3 = 0").select("archive", "ordinal", F.lit(1).alias("seq"), T.div(c("width"), 2).cast("int").alias("width"), T.div(c("height"), 2).cast("int").alias("height"), F.lit(0).alias("format"), "mips")
    two = t.where("ordinal % 6 = 0").select("archive", "ordinal", F.lit(2).alias("seq"), T.div(c("width"), 4).cast("int").alias("width"), T.div(c("height"), 4).cast("int").alias("height"), "format", F.lit(1).alias("mips"))
    return one.unionByName(two)


@query("overlay_current_state", sql(["tex_parts", _EDITS], _CURRENT))
def overlay_current_state(spark, d):
    return edits.current(tex_parts(spark, d), _edits(spark, d))


@query("overlay_revert", sql(["tex_parts", _EDITS.replace("last AS (SELECT * FROM edits ", "last AS (SELECT * FROM edits WHERE archive <> 'Brand#2' ")], _CURRENT))
def overlay_revert(spark, d):
    t = tex_parts(spark, d)
    return edits.current(t, edits.reverted(_edits(spark, d), t.where(c("archive") == "Brand#2")))


@query("remove_textures", sql(["tex_parts"], "SELECT archive, ordinal FROM tex_parts WHERE name NOT IN ('red widget', 'blue bolt')"))
def remove_textures(spark, d):
    t = tex_parts(spark, d)
    return edits.without_textures(t, t.where(c("name").isin("red widget", "blue bolt"))).select("archive", "ordinal")


@query("unload_group", sql(["archives"], "SELECT archive, parent, is_group FROM archives WHERE archive <> (SELECT min(r_name) FROM region) AND coalesce(parent, '') <> (SELECT min(r_name) FROM region)"))
def unload_group(spark, d):
    first = read(spark, d, "region").agg(F.min("r_name").alias("archive"))
    return edits.without_archives(archives_of_nations(spark, d), first)


@query("clear_all", sql(["archives"], "SELECT * FROM archives WHERE false"))
def clear_all(spark, d):
    return edits.cleared(archives_of_nations(spark, d))
