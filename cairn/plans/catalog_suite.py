"""Every catalog operator as a query over the test tables, with the same question in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import content, expr
from cairn.operators import catalog, changes, rules
from cairn.operators.rules import ARCHIVE, IGNORE, ScanRule
from cairn.shipping import ship
from cairn.sources import corpus, fswalk

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The catalog in SQL. Digits of base 32 are written with the identifiers' own alphabet.
_CID = "(SELECT 'b' || substr(translate(string_agg(to_base(('0x' || substr(h, 1 + 5 * i, 5))::INT, 32, 4), '' ORDER BY i), '{d}', '{a}'), 1, 58) FROM (SELECT rpad(upper('01551220' || sha256({c})), 75, '0') AS h), range(15) t(i))"


def _cid(content: str) -> str:
    return _CID.format(d=expr.DIGITS32, a=expr.BASE32, c=content)


_PATHS = f"""paths AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.' || lang AS path, {_cid("text")} AS cid,
    strlen(text) AS original_size, n_chars AS compressed_size, 1700000000 + doc_id AS modified, 33188 AS permissions FROM documents)"""
_DIRS = "dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path FROM paths, range(2, 4) t(n))"
_SIZES = "sizes AS (SELECT cid, count(*) AS n FROM paths GROUP BY cid)"
_EXT = """ext AS (SELECT CASE WHEN e = '' THEN '(no ext)' ELSE e END AS extension, count(*) AS total_files, sum((n > 1)::INT)::BIGINT AS duplicate_files,
    round(sum((n > 1)::INT)::DOUBLE / count(*) * 100 * 10) / 10 AS duplicate_pct, sum(original_size)::BIGINT AS total_original_bytes, sum(compressed_size)::BIGINT AS total_stored_bytes,
    greatest(sum(original_size) - sum(compressed_size), 0)::BIGINT AS bytes_saved
    FROM (SELECT *, lower(string_split(path, '.')[-1]) AS e FROM paths JOIN sizes USING (cid)) GROUP BY e)"""
# Two snapshots: A is in the catalog, B is scanned; every thirteenth blob is gone.
_SNAP = f"""a AS (SELECT * FROM paths WHERE doc_id % 10 <> 0),
b AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN {_cid("t")} ELSE cid END AS cid, strlen(t) AS size, length(t) AS compressed_size, modified + (doc_id % 7 = 0)::INT AS modified
    FROM (SELECT p.*, CASE WHEN p.doc_id % 7 = 0 THEN text || '!' ELSE text END AS t FROM paths p JOIN documents d USING (doc_id)) WHERE doc_id % 10 <> 1),
blobs AS (SELECT DISTINCT cid FROM a WHERE doc_id % 13 <> 0),
cmp AS (SELECT b.*, a.cid AS known, CASE WHEN a.path IS NULL THEN 'new' WHEN a.original_size = b.size AND a.modified = b.modified AND a.cid IN (SELECT cid FROM blobs) THEN 'unchanged' ELSE 'modified' END AS status
    FROM b LEFT JOIN a USING (path))"""
_STATS = """(SELECT count(*) FROM {c}) + (SELECT count(*) FROM {u}) AS total_files, {dirs} AS total_dirs,
    (SELECT count(DISTINCT cid) FROM {c} WHERE cid NOT IN (SELECT cid FROM {k})) AS unique_blobs,
    (SELECT count(*) FROM {c}) - (SELECT count(DISTINCT cid) FROM {c} WHERE cid NOT IN (SELECT cid FROM {k})) AS duplicate_files,
    ((SELECT coalesce(sum(size), 0) FROM {c}) + (SELECT coalesce(sum(size), 0) FROM {u}))::BIGINT AS total_original_bytes,
    (SELECT coalesce(sum(s), 0) FROM (SELECT max(compressed_size) AS s FROM {c} WHERE cid NOT IN (SELECT cid FROM {k}) GROUP BY cid))::BIGINT AS total_stored_bytes,
    0::BIGINT AS skipped_files, (SELECT count(*) FROM {u}) AS unchanged_files, {pruned} AS pruned_entries"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _paths(spark, d) -> DataFrame:
    return corpus.document_paths(corpus.documents(spark, d))


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    paths = _paths(spark, d)
    return paths, catalog.parent_dirs(paths)


# statistics ---------------------------------------------------------------------------------------------------


@query(_with(_PATHS, _SIZES, _EXT) + "SELECT * FROM ext")
def extension_stats(spark, d):
    return catalog.extension_stats(_paths(spark, d))


@query(_with(_PATHS, _DIRS, _SIZES) + """SELECT count(*) AS total_files, (SELECT count(*) FROM dirs) AS total_dirs, (SELECT count(*) FROM sizes) AS unique_blobs,
    (SELECT sum(n)::BIGINT FROM sizes WHERE n > 1) AS duplicate_files, sum(original_size)::BIGINT AS total_original_bytes, sum(compressed_size)::BIGINT AS total_stored_bytes,
    (SELECT sum(c)::BIGINT FROM (SELECT max(compressed_size) AS c FROM paths GROUP BY cid)) AS unique_stored_bytes FROM paths""")
def store_stats(spark, d):
    return catalog.store_stats(*_both(spark, d))


@query(_with(_PATHS) + "SELECT cid, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM paths GROUP BY cid HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return catalog.duplicate_groups(catalog.index_of(_paths(spark, d))).select("cid", F.size("paths").cast("long").alias("n"), F.array_join("paths", ",").alias("paths"))


@query(_with(_PATHS, _SIZES) + "SELECT cid, path FROM paths JOIN sizes USING (cid) WHERE n > 1")
def duplicate_members(spark, d):
    return catalog.duplicate_members(catalog.index_of(_paths(spark, d)))


@query(_with(_PATHS, _SIZES) + "SELECT * FROM sizes")
def duplicate_group_sizes(spark, d):
    return catalog.group_sizes(catalog.index_of(_paths(spark, d)))


@query(_with(_PATHS, _SIZES) + "SELECT path, n > 1 AS dup FROM paths JOIN sizes USING (cid)")
def duplicate_flags(spark, d):
    return catalog.flagged(_paths(spark, d)).select("path", "dup")


@query(_with(_PATHS) + "SELECT count(DISTINCT cid) AS contents FROM paths")
def distinct_contents(spark, d):
    return _paths(spark, d).agg(F.count_distinct("cid").alias("contents"))


@query(_with(_PATHS) + "SELECT sum(original_size)::BIGINT AS original, sum(compressed_size)::BIGINT AS stored, round((1 - sum(compressed_size)::DOUBLE / sum(original_size)) * 100, 1) AS saved_pct FROM paths")
def space_saved(spark, d):
    s = _paths(spark, d).agg(F.sum("original_size").alias("original"), F.sum("compressed_size").alias("stored"))
    return s.withColumn("saved_pct", F.round(expr.space_saved(F.col("original"), F.col("stored")), 1))


def _top(name: str, by: str, least: int):
    @query(_with(_PATHS, _SIZES, _EXT) + f"SELECT *, row_number() OVER (ORDER BY {by} DESC, extension) AS rank FROM ext WHERE total_files >= {least}")
    def f(spark, d):
        return catalog.top_extensions(catalog.extension_stats(_paths(spark, d)), by, least)

    for table in (QUERIES, SQL):
        table[name] = table.pop("f")
    f.__name__ = name


for _name, _by, _least in (("ext_top_saved", "bytes_saved", 1), ("ext_top_dup_pct", "duplicate_pct", 2), ("ext_top_dup_count", "duplicate_files", 1), ("ext_top_files", "total_files", 1)):
    _top(_name, _by, _least)


@query(_with(_PATHS, _SIZES, _EXT) + """SELECT sum(bytes_saved)::BIGINT AS bytes_saved, sum(duplicate_files)::BIGINT AS duplicate_files, sum(total_files)::BIGINT AS total_files,
    max(bytes_saved) AS max_bytes_saved, max(duplicate_files) AS max_duplicate_files, max(total_files) AS max_total_files FROM ext""")
def ext_totals(spark, d):
    return catalog.extension_totals(catalog.extension_stats(_paths(spark, d)))


# lookups and listings -----------------------------------------------------------------------------------------


@query(_with(_PATHS) + "SELECT path, cid, original_size, compressed_size, modified, permissions FROM paths WHERE path = (SELECT min(path) FROM paths)")
def file_lookup(spark, d):
    paths = _paths(spark, d)
    return catalog.get_file(paths, paths.agg(F.min("path")).first()[0]).drop("created")


_DUP_PATH = "(SELECT min(path) FROM paths JOIN sizes USING (cid) WHERE n > 1)"


def _dup_path(paths: DataFrame) -> str:
    return catalog.flagged(paths).where("dup").agg(F.min("path")).first()[0]


@query(_with(_PATHS, _SIZES) + f"SELECT path FROM paths WHERE cid = (SELECT cid FROM paths WHERE path = {_DUP_PATH})")
def duplicates_of_path(spark, d):
    paths = _paths(spark, d)
    return catalog.duplicates_of_path(paths, _dup_path(paths))


@query(_with(_PATHS) + "SELECT path FROM paths WHERE cid = (SELECT max(cid) FROM paths)")
def duplicates_of_cid(spark, d):
    paths = _paths(spark, d)
    return catalog.duplicates_of_cid(catalog.index_of(paths), paths.agg(F.max("cid")).first()[0])


_SHOWN = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f KB', {0} / 1024.0::DOUBLE) ELSE printf('%.1f MB', {0} / 1048576.0::DOUBLE) END"


@query(_with(_PATHS, _SIZES) + f"""SELECT p.path, p.cid, {_SHOWN.format("p.original_size")} AS size, {_SHOWN.format("p.compressed_size")} AS stored,
    round(p.compressed_size::DOUBLE / p.original_size * 100, 1) AS ratio, strftime(make_timestamp(p.modified * 1000000), '%Y-%m-%d %H:%M:%S') AS modified, '100644' AS mode,
    q.path AS duplicate, q.path = p.path AS this_file FROM paths p JOIN paths q USING (cid) WHERE p.path = {_DUP_PATH}""")
def file_info(spark, d):
    paths = _paths(spark, d)
    return catalog.file_info(paths, _dup_path(paths))


def _listing(name: str, path: str):
    prefix = path.rstrip("/") + "/"

    @query(_with(_PATHS) + f"""SELECT string_split(r, '/')[1] AS name, contains(r, '/') AS is_dir, max(CASE WHEN contains(r, '/') THEN 0 ELSE original_size END)::BIGINT AS size,
        max(CASE WHEN contains(r, '/') THEN 0 ELSE modified END)::BIGINT AS modified FROM (SELECT substr(path, {len(prefix) + 1}) AS r, * FROM paths WHERE starts_with(path, '{prefix}')) GROUP BY 1, 2""")
    def f(spark, d):
        return catalog.list_dir(*_both(spark, d), path)

    for table in (QUERIES, SQL):
        table[name] = table.pop("f")


for _name, _path in (("list_dir_root", "/"), ("list_dir_source", "/src1"), ("list_dir_leaf", "/src1/en"), ("list_dir_missing", "/nope")):
    _listing(_name, _path)


@query(_with(_PATHS) + "SELECT path, original_size FROM paths WHERE starts_with(path, '/src1/')")
def prefix_scan(spark, d):
    return catalog.under(_paths(spark, d), "/src1/").select("path", "original_size")


@query(_with(_PATHS, _DIRS) + "SELECT path, 0::BIGINT AS child_count, 0::BIGINT AS modified FROM dirs")
def dirs_from_paths(spark, d):
    return catalog.parent_dirs(_paths(spark, d))


@query(_with(_PATHS, _DIRS) + "SELECT path, is_dir, (length(path) - length(replace(path, '/', '')))::INT AS depth FROM (SELECT path, false AS is_dir FROM paths UNION ALL SELECT path, true FROM dirs)")
def tree_expand(spark, d):
    return catalog.tree(*_both(spark, d))


# rules --------------------------------------------------------------------------------------------------------

RULES = [ScanRule(r"(^|/)src1[0-4]$", ARCHIVE), ScanRule(r"(^|/)fr$", IGNORE), ScanRule(r"(^|/)src[23]/es$", ARCHIVE), ScanRule(r"7\.en$", IGNORE), ScanRule(r"9\.de$", ARCHIVE)]
EXTRA = ["src10.tar", "src2/es.tar", "src2/en.tar", "src5/.tar", "fr.tar"]
_ACTION = lambda r: f"CASE WHEN {r} = '' THEN NULL " + " ".join(f"WHEN regexp_matches({r}, '{x.pattern}') THEN '{x.action}'" for x in RULES) + " END"
_ENTRIES = f"""entries AS (SELECT substr(path, 2) AS rel, 'file' AS kind FROM paths UNION ALL SELECT substr(path, 2), 'dir' FROM dirs UNION ALL SELECT unnest({EXTRA!r}), 'file'),
acted AS (SELECT *, {_ACTION("rel")} AS action FROM entries),
marked AS (SELECT *, CASE WHEN action = 'ignore' THEN 'ignore' WHEN action = 'archive' AND kind = 'dir' THEN 'archive' WHEN action = 'archive' THEN 'skip'
    WHEN NOT regexp_matches(rel, '(^|/)\\.tar$') AND rel IN (SELECT rel || '.tar' FROM acted WHERE kind = 'dir' AND action = 'archive') THEN 'collision' ELSE 'plain' END AS decision FROM acted),
visited AS (SELECT * FROM marked m WHERE NOT EXISTS (SELECT 1 FROM marked u WHERE u.decision <> 'plain' AND starts_with(m.rel, u.rel || '/')))"""


def _entries(spark, d) -> DataFrame:
    extra = spark.createDataFrame([(x, "file") for x in EXTRA], "rel string, kind string")
    return corpus.entries_of(*_both(spark, d)).unionByName(extra)


@query(_with(_PATHS, _DIRS, _ENTRIES) + "SELECT rel, kind, action FROM acted")
def rule_first_match(spark, d):
    return _entries(spark, d).withColumn("action", rules.first_match(F.col("rel"), RULES))


@query(_with(_PATHS, _DIRS, _ENTRIES) + "SELECT rel, kind, decision FROM visited")
def rule_decisions(spark, d):
    return rules.decided(_entries(spark, d), RULES)


@query(_with(_PATHS, _DIRS, _ENTRIES) + "SELECT rel, kind FROM visited WHERE decision = 'plain'")
def rule_ignore_subtree(spark, d):
    return rules.decided(_entries(spark, d), RULES).where("decision = 'plain'").select("rel", "kind")


@query(_with(_PATHS, _DIRS, _ENTRIES) + """SELECT '/repo/' || rel || CASE WHEN decision = 'archive' THEN '.tar' ELSE '' END AS path, decision = 'archive' AS archived FROM visited
    WHERE decision = 'archive' OR decision = 'plain' AND kind = 'file'""")
def rule_archive_collapse(spark, d):
    kept = rules.decided(_entries(spark, d), RULES).where("decision = 'archive' or (decision = 'plain' and kind = 'file')")
    at = expr.virtual_path("/repo", F.col("rel"))
    return kept.select(F.when(F.col("decision") == "archive", F.concat(at, F.lit(".tar"))).otherwise(at).alias("path"), (F.col("decision") == "archive").alias("archived"))


@query(_with(_PATHS, _DIRS, _ENTRIES) + "SELECT rel FROM visited WHERE decision = 'collision'")
def rule_collision(spark, d):
    return rules.decided(_entries(spark, d), RULES).where("decision = 'collision'").select("rel")


@query(_with(_PATHS, _DIRS, _ENTRIES) + "SELECT decision, count(*) AS n FROM visited GROUP BY decision")
def rule_skip_counts(spark, d):
    return rules.decided(_entries(spark, d), RULES).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


# changes between snapshots ------------------------------------------------------------------------------------


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = corpus.documents(spark, d)
    a = corpus.document_paths(docs.where("doc_id % 10 <> 0"))
    changed = F.col("doc_id") % 7 == 0
    text = F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    b = corpus.document_paths(docs.where("doc_id % 10 <> 1").withColumn("text", text).withColumn("n_chars", F.char_length("text")))
    bump = (F.col("modified") - 1_700_000_000) % 7 == 0
    b = b.select("path", "cid", F.col("original_size").alias("size"), "compressed_size", (F.col("modified") + bump.cast("int")).alias("modified"))
    blobs = corpus.document_paths(docs.where("doc_id % 10 <> 0 and doc_id % 13 <> 0")).select("cid").distinct()
    return a, b, blobs


@query(_with(_PATHS, _SNAP) + "SELECT path, status, known FROM cmp")
def change_detection(spark, d):
    a, b, blobs = _snapshots(spark, d)
    return changes.compared(b, a, blobs).select("path", "status", F.col("known_cid").alias("known"))


@query(_with(_PATHS, _SNAP) + "SELECT path, size FROM cmp WHERE status = 'unchanged'")
def unchanged_files(spark, d):
    a, b, blobs = _snapshots(spark, d)
    return changes.compared(b, a, blobs).where("status = 'unchanged'").select("path", "size")


@query(_with(_PATHS, _DIRS) + ", c AS (SELECT cid, original_size AS size, compressed_size FROM paths), u AS (SELECT * FROM c WHERE false), k AS (SELECT cid FROM c WHERE false) SELECT " + _STATS.format(c="c", u="u", k="k", dirs="(SELECT count(*) FROM dirs)", pruned="0::BIGINT"))
def scan_stats_initial(spark, d):
    paths, dirs = _both(spark, d)
    c = paths.select("cid", F.col("original_size").alias("size"), "compressed_size")
    return changes.scan_stats(c, c.limit(0), c.select("cid").limit(0), dirs)


@query(_with(_PATHS, _SNAP) + """, c AS (SELECT * FROM cmp WHERE status <> 'unchanged'), u AS (SELECT * FROM cmp WHERE status = 'unchanged'),
    bd AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path FROM b, range(2, 4) t(n)),
    gone AS (SELECT path FROM a WHERE path NOT IN (SELECT path FROM b)) SELECT """ + _STATS.format(c="c", u="u", k="blobs", dirs="(SELECT count(*) FROM bd)", pruned="(SELECT count(*) FROM gone)"))
def scan_stats_incremental(spark, d):
    a, b, blobs = _snapshots(spark, d)
    cmp = changes.compared(b, a, blobs)
    return changes.scan_stats(cmp.where("status <> 'unchanged'"), cmp.where("status = 'unchanged'"), blobs, catalog.parent_dirs(b), 0, changes.deleted(a, b))


@query(_with(_PATHS, _SNAP) + "SELECT path FROM a WHERE path NOT IN (SELECT path FROM b)")
def prune_missing(spark, d):
    a, b, _ = _snapshots(spark, d)
    return changes.deleted(a, b).select("path")


@query(_with(_PATHS, _SNAP) + "SELECT path FROM a WHERE NOT starts_with(path, '/src1/') OR path IN (SELECT path FROM b)")
def prune_scoped(spark, d):
    a, b, _ = _snapshots(spark, d)
    return changes.pruned(a, b, "/src1").select("path")


@query(_with(_PATHS, _SNAP) + "SELECT path, cid, size FROM b UNION ALL SELECT path, cid, original_size FROM a WHERE path NOT IN (SELECT path FROM b)")
def incremental_merge(spark, d):
    a, b, _ = _snapshots(spark, d)
    return changes.merged(a.select("path", "cid", F.col("original_size").alias("size")), b.select("path", "cid", "size"))


@query(_with(_PATHS, _SNAP) + "SELECT cid, path FROM a UNION SELECT cid, path FROM b")
def stale_index_additive(spark, d):
    a, b, _ = _snapshots(spark, d)
    return changes.additive_index(catalog.index_of(a), b)


@query(_with(_PATHS, _SNAP) + "SELECT cid, max(size) AS size FROM b WHERE cid NOT IN (SELECT cid FROM blobs) GROUP BY cid")
def new_blobs(spark, d):
    _, b, blobs = _snapshots(spark, d)
    return changes.new_blobs(b, blobs).select("cid", "size")


@query("""SELECT path, seq, value FROM (SELECT '/u/' || user_id AS path, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def last_write_wins(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), "value")
    return changes.last_writes(e)


_HISTORY = """h AS (SELECT user_id AS workspace, event_id % 50 AS files, event_id % 7 AS duplicates, event_id % 1000 + 100 AS original, event_id % 900 AS stored, event_id AS scanned_at FROM events),
w AS (SELECT workspace, sum(files)::BIGINT AS total_files, sum(duplicates)::BIGINT AS duplicate_files, sum(original)::BIGINT AS total_original_bytes, sum(stored)::BIGINT AS total_stored_bytes, count(*) AS scans_count, max(scanned_at) AS last_scan_at FROM h GROUP BY workspace)"""


def _history(spark, d) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("workspace"), (e % 50).alias("files"), (e % 7).alias("duplicates"), (e % 1000 + 100).alias("original"), (e % 900).alias("stored"), e.alias("scanned_at"))


@query(_with(_HISTORY) + "SELECT * FROM w")
def workspace_totals(spark, d):
    return changes.workspace_totals(_history(spark, d))


@query(_with(_HISTORY) + """SELECT sum(total_files)::BIGINT AS total_files, sum(duplicate_files)::BIGINT AS duplicate_files, sum(total_original_bytes)::BIGINT AS total_original_bytes, sum(total_stored_bytes)::BIGINT AS total_stored_bytes,
    greatest(sum(total_original_bytes) - sum(total_stored_bytes), 0)::BIGINT AS bytes_saved, round((sum(total_original_bytes) - sum(total_stored_bytes))::DOUBLE / sum(total_original_bytes) * 100, 1) AS saved_pct FROM w""")
def all_workspaces(spark, d):
    return changes.all_workspaces(changes.workspace_totals(_history(spark, d)))


# scalar functions ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_cid('text')} AS cid FROM documents")
def cid_string_sha256(spark, d):
    return corpus.documents(spark, d).select("doc_id", expr.content_cid(F.col("text")).alias("cid"))


@query("SELECT doc_id, upper('01551220' || sha256(text)) AS cid_hex FROM documents")
def cid_round_trip(spark, d):
    return corpus.documents(spark, d).select("doc_id", F.hex(expr.cid_string_to_bytes(expr.content_cid(F.col("text")))).alias("cid_hex"))


@query(f"SELECT doc_id, {_SHOWN.format('n_chars * (doc_id % 50)')} AS shown, lpad({_SHOWN.format('n_chars * (doc_id % 50)')}, 10, ' ') AS padded FROM documents")
def format_size(spark, d):
    size = F.col("n_chars") * (F.col("doc_id") % 50)
    return corpus.documents(spark, d).select("doc_id", expr.format_size(size).alias("shown"), expr.pad_left(expr.format_size(size)).alias("padded"))


@query("SELECT doc_id, to_base(doc_id, 8) AS mode, CASE WHEN doc_id % 5 = 0 THEN '—' ELSE strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%d %H:%M:%S') END AS shown, round(n_chars::DOUBLE / strlen(text) * 100, 1) AS ratio, substr(sha256(text), 1, 20) AS short FROM documents")
def display_forms(spark, d):
    t = F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("doc_id"))
    return corpus.documents(spark, d).select("doc_id", expr.octal(F.col("doc_id")).alias("mode"), expr.shown_time(t).alias("shown"), expr.compression_ratio(F.octet_length("text"), F.col("n_chars")).alias("ratio"), expr.short_cid(F.sha2("text", 256)).alias("short"))


@query("""SELECT doc_id, p, CASE WHEN contains(b, '.') THEN lower(string_split(b, '.')[-1]) ELSE '' END AS extension, b AS name,
    CASE WHEN lower(b) LIKE '%.png' THEN 'image/png' WHEN lower(b) LIKE '%.jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS image
    FROM (SELECT doc_id, p, string_split(p, '/')[-1] AS b FROM (SELECT doc_id, '/a.b/' || doc_id || (['.PNG', '.tar.gz', '.', '', '.jpg', '/.gitignore'])[doc_id % 6 + 1] AS p FROM documents))""")
def path_names(spark, d):
    tails = F.array(*(F.lit(x) for x in (".PNG", ".tar.gz", ".", "", ".jpg", "/.gitignore")))
    p = F.concat(F.lit("/a.b/"), F.col("doc_id").cast("string"), F.element_at(tails, (F.col("doc_id") % 6 + 1).cast("int")))
    docs = corpus.documents(spark, d).select("doc_id", p.alias("p"))
    return docs.select("doc_id", "p", expr.extension(F.col("p")).alias("extension"), expr.basename(F.col("p")).alias("name"), expr.image_type(F.col("p")).alias("image"))


# contents: what SQL doesn't have -------------------------------------------------------------------------------


@query()
def blake3_cid(spark, d):
    return content.blake3_cids(corpus.documents(spark, d).select("doc_id", "text"), "text").select("doc_id", "cid")


@query("SELECT doc_id, strlen(text) AS n_bytes, true AS same FROM documents")
def lz4_roundtrip(spark, d):
    ship(spark)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            back = [content.unlz4(content.lz4(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back)])], ["doc_id", "n_bytes", "same"])

    return corpus.documents(spark, d).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, same boolean")


@query()
def archive_tar(spark, d):
    """The library's own sources as one archive: its name, size and identity."""
    data = content.directory_archive(_PACKAGE, "package")
    return spark.createDataFrame([("package.tar", len(data), content.cid_text(content.compute_cid(data)))], "name string, size long, cid string")


@query()
def fs_scan(spark, d):
    """A walk of the folder that holds the tables."""
    return fswalk.walk(spark, d, 4).select("rel", "kind", "size")
