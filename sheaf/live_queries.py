"""Registered queries that write and read real archives and stores, and those of small functions.

``documents`` is packed into archives, read back by the data sources, and synchronised into a
store that holds an older state of it.  What is written lies in the shared scratch folder; the live
run over a table is made once per session and looked at by several queries.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import api
from sheaf.functions import etags, paths, text, tuning
from sheaf.operators import diagnostics, fixtures, selection, spans
from sheaf.plans import pack, reports, sync
from sheaf.plans.options import PackOptions, SyncOptions
from sheaf.sources import scratch, sinks, trees, zip_source
from sheaf.sources.stores import open_tree

#: Archives that one source's documents are dealt to.
SPREAD = 4


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    return F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".txt")))


def _name() -> Column:
    return F.concat("source", F.lit("-"), F.col("doc_id") % SPREAD, F.lit(".zip"))


def _archives(spark: SparkSession, rows: DataFrame, opts: PackOptions = PackOptions()) -> str:
    """Write archives of (archive, zip_path, content) into a new folder; its path."""
    folder = f"{scratch.folder(spark)}/archives-{uuid.uuid4().hex}".removeprefix("file://")
    sinks.pack_groups(rows, folder, opts)
    return folder


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(_name().alias("archive"), _path().alias("zip_path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _packed(spark: SparkSession, sf_dir: str) -> list[str]:
    """Paths of the archives of all documents."""

    def make():
        folder = _archives(spark, _entries(spark, sf_dir))
        return [f"{folder}/{k}" for k, _, _ in open_tree(folder)[0].list() if k.endswith(".zip")]

    return _once(spark, sf_dir, "packed", make)


def _live(spark: SparkSession, sf_dir: str) -> tuple[str, api.Report]:
    """A store with an older state and extras, then synchronised with all archives.

    The folder of the extras stays, as an empty one."""

    def make():
        old = _t(spark, sf_dir, "documents").where("doc_id % 10 <> 3")
        body = F.when(F.col("doc_id") % 20 < 2, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.coalesce("text", F.lit("")))
        files = old.select(F.lit("old.zip").alias("archive"), _path().alias("zip_path"), body.cast("binary").alias("content"))
        extra = _t(spark, sf_dir, "pages").select(F.lit("old.zip"), F.concat(F.lit("extra/"), F.col("page_id")), F.coalesce("url", F.lit("")).cast("binary"))
        folder = _archives(spark, files.union(extra))
        root = f"{scratch.folder(spark)}/store-{uuid.uuid4().hex}".removeprefix("file://")
        api.sync(spark, f"{folder}/old.zip", root, SyncOptions(prefix="site"))
        return root, api.sync(spark, _packed(spark, sf_dir), root, SyncOptions(prefix="site", delete_extra=True))

    return _once(spark, sf_dir, "live", make)


# --- archives ---------------------------------------------------------------------------------


def q_zip_manifest(spark, sf_dir):
    zip_source.register(spark)
    rows = spark.read.format("zip_manifest").option("paths", json.dumps(_packed(spark, sf_dir))).load()
    rows = rows.where(F.col("raw_path") != paths.CATALOG_PATH)
    return rows.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), F.col("raw_path").alias("zip_path"), "size", (F.col("header_offset") < F.col("span_end")).alias("has_span"))


def q_zip_entries(spark, sf_dir):
    zip_source.register(spark)
    rows = spark.read.format("zip_entries").option("paths", json.dumps(_packed(spark, sf_dir))).option("splitBytes", 1 << 16).load()
    rows = rows.where((F.col("raw_path") != paths.CATALOG_PATH) & F.col("error").isNull())
    return rows.select(F.col("raw_path").alias("zip_path"), F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("md5"))


def q_read_planned_blocks(spark, sf_dir):
    """Only the asked entries, by small planned blocks under a narrow window."""
    records = zip_source.manifest(spark, _packed(spark, sf_dir)).where(F.col("raw_path").startswith("en/"))
    opts = SyncOptions(block_size=16384, merge_gap=2048, window_size=65536, get_concurrency=3)
    rows = zip_source.read_entries(records, opts, split=1 << 17)
    return rows.select(F.col("raw_path").alias("zip_path"), F.md5("content").alias("md5"), "error")


def q_inspect_archives(spark, sf_dir):
    rows = zip_source.inspect(zip_source.manifest(spark, _packed(spark, sf_dir)), paths.CATALOG_PATH)
    return rows.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "file_count", (F.col("size") > 0).alias("has_bytes"))


def q_embedded_catalog(spark, sf_dir):
    records = zip_source.manifest(spark, _packed(spark, sf_dir))
    found = sync.catalog_entries(zip_source.catalog_of(records, paths.CATALOG_PATH), paths.CATALOG_PATH)
    return found.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "zip_path", "catalog_md5")


def q_live_sync(spark, sf_dir):
    return _live(spark, sf_dir)[1].operations.select("status", "key", "zip_path", "size", "md5")


def q_live_summary(spark, sf_dir):
    return _live(spark, sf_dir)[1].summary


def q_live_puts(spark, sf_dir):
    found = _live(spark, sf_dir)[1].put_diagnostics()
    return found.select("attempts", "failed_attempts", "retry_attempts", "throttled_attempts", F.cardinality("failures_by_error_code").cast("long").alias("codes"))


def q_live_planned(spark, sf_dir):
    return _live(spark, sf_dir)[1].planned.select("planned_entries", (F.col("planned_blocks") >= F.col("planned_entries")).alias("blocks_cover"), (F.col("planned_bytes") > 0).alias("has_bytes"))


def q_live_listing(spark, sf_dir):
    """What the store holds afterwards, listed and digested anew."""
    root, _ = _live(spark, sf_dir)
    return trees.listing(spark, root, "site").select("key", etags.normalize_etag(F.col("etag")).alias("md5"), "size")


def q_live_resync(spark, sf_dir):
    """A second run finds all in place and writes nothing, with the catalog and by digests."""
    root, _ = _live(spark, sf_dir)
    runs = [api.sync(spark, _packed(spark, sf_dir), root, SyncOptions(prefix="site", use_catalog=c)).summary.withColumn("catalog", F.lit(c)) for c in (True, False)]
    return runs[0].unionByName(runs[1])


def q_live_tree(spark, sf_dir):
    root, _ = _live(spark, sf_dir)
    return trees.tree(spark, f"{root}/site").select("zip_path", "size", "kind")


def q_extract_local(spark, sf_dir):
    """All archives' files in a folder, extracted twice: the statuses of the second run."""
    root = f"{scratch.folder(spark)}/out-{uuid.uuid4().hex}".removeprefix("file://")
    for again in range(2):
        report = api.extract_local(spark, _packed(spark, sf_dir), root)
    return report.operations.select("status", "zip_path", "size")


def q_pack_folder(spark, sf_dir):
    """The synchronised store packed as one archive: its plan, and what the archive then holds."""
    root, _ = _live(spark, sf_dir)
    archive = f"{scratch.folder(spark)}/made-{uuid.uuid4().hex}.zip".removeprefix("file://")
    planned = api.plan_pack(spark, f"{root}/site")
    api.pack(spark, f"{root}/site", archive)
    return planned.crossJoin(api.inspect(spark, archive).select("file_count"))


_DOCS = "docs AS (SELECT *, coalesce(text, '') AS body, lang || '/' || source || '/' || doc_id || '.txt' AS zip_path, source || '-' || (doc_id % 4) || '.zip' AS archive FROM documents)"
_STATE = "CASE WHEN doc_id % 10 = 3 THEN 'uploaded_new' WHEN doc_id % 20 < 2 THEN 'uploaded_changed' ELSE 'skipped_unchanged' END"


# --- plans and small functions -----------------------------------------------------------------


def q_prepared_entries(spark, sf_dir):
    """Raw records: the catalog's path goes, then the selection, and only then checks of entries."""
    d = _t(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 7 == 0  # broken entries, none of which is selected
    raw = d.select(
        F.when(F.col("doc_id") % 50 == 1, paths.CATALOG_PATH).when(odd, F.concat(F.lit("broken/"), F.col("doc_id"))).otherwise(_path()).alias("raw_path"), F.octet_length("text").cast("long").alias("size"),
        F.lit(1).cast("long").alias("compressed_size"), F.lit(1).cast("long").alias("crc32"), F.when(odd, "method-99").otherwise("deflate").alias("compression"), F.lit(None).cast("string").alias("archive"),
    )
    chosen = SyncOptions(prefix="site/x", selection=selection.Selection().exclude("broken/"))
    return sync.prepared(raw, chosen).select("zip_path", "key", "is_directory", "size")


def q_entry_errors(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    k = F.col("page_id") % 6
    rows = p.select("page_id", (k < 2).alias("is_directory"), F.when(k == 1, 5).when(k == 5, 1 << 40).otherwise(F.when(k == 0, 0).otherwise(9)).cast("long").alias("size"), F.lit(0).cast("long").alias("compressed_size"), F.lit(0).cast("long").alias("crc32"), F.when(k == 3, "method-12").otherwise("zstd").alias("compression"))
    return rows.select("page_id", sync.entry_error().alias("error"))


def q_selection_dialect(spark, sf_dir):
    """Raw lines of the dialect: comments, blank lines, escapes, classes and trailing spaces."""
    lines = selection.Selection().patterns("# a comment", "", "   ", "e?/**", "d[a-e]/src[!0-4]/*.txt", "!*1.txt  ", "\\#none", "!\\!none")
    d = _t(spark, sf_dir, "documents").select("doc_id", _path().alias("zip_path"))
    return d.where(selection.selected(F.col("zip_path"), lines)).select("doc_id", "zip_path")


def q_listing_to_tree(spark, sf_dir):
    """Objects under a prefix as entries of an archive to be packed."""
    listing = _t(spark, sf_dir, "pages").select(F.concat(F.lit("a/b/"), F.when(F.col("page_id") % 9 == 0, F.concat("page_id", F.lit("/"))).otherwise(F.concat("page_id", F.lit(".html")))).alias("key"), F.when(F.col("page_id") % 9 == 0, 0).otherwise(F.octet_length("html")).cast("long").alias("size"), F.md5("url").alias("etag"))
    return pack.tree_from_listing(listing, "a/b/").select("zip_path", "size", "kind", "key")


def q_key_errors(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    key = F.element_at(F.array(*map(F.lit, ("p/ok", "q/no", "p/", "p/d/", "p/../x", "p/a//b", "p//"))), (F.col("page_id") % 7 + 1).cast("int"))
    size = F.col("page_id") % 2
    rows = p.select("page_id", key.alias("key"), size.alias("size"))
    return rows.select("page_id", "key", paths.list_prefix(F.lit("p")).alias("head"), paths.key_to_path(F.lit("p"), F.col("key")).alias("path"), paths.key_entry_error(F.lit("p"), F.col("key"), F.col("size")).alias("error"))


def q_span_bounds(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 13 % 1000).alias("start"), (F.col("event_id") * 7 % 1100).alias("stop"), F.lit(900).cast("long").alias("length"), F.lit(800).cast("long").alias("limit"))
    return e.select("event_id", spans.span_error("start", "stop", "length", "limit").alias("error"))


def q_request_errors(spark, sf_dir):
    """Conflicts, retryable kinds, codes and messages of failed requests."""
    e = _t(spark, sf_dir, "events")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n + 1).cast("int"))
    rows = e.select("event_id", pick(5, 200, 409, 412, 500, None).alias("status"), pick(4, "SlowDown", "PreconditionFailed", None, "ConditionalRequestConflict").alias("code"), pick(3, "s3", "io", "zip").alias("kind"), pick(7, "invalid_data", "timed out", None, "invalid_input", "reset", None, "eof").alias("io_kind"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("message"))
    c = {x: F.col(x) for x in rows.columns}
    return rows.select("event_id", tuning.is_conflict(c["status"], c["code"]).alias("conflict"), tuning.is_retryable(c["kind"], c["io_kind"]).alias("retryable"), tuning.failure_code(c["code"], c["io_kind"]).alias("failure"), tuning.error_message(c["code"], c["message"], c["kind"]).alias("text"))


def q_local_names(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.coalesce(F.regexp_extract("url", r"://([^?#]*)", 1), F.lit("")).alias("name"))
    return p.select("page_id", paths.swap_case(F.col("name")).alias("swapped"), paths.local_target("/out/", F.col("name")).alias("target"), paths.safe_manifest_path(F.col("name")).alias("safe"))


def q_text_formats(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 977).cast("long").alias("n"), (F.col("o_orderkey") % 5000).alias("s"))
    return o.select("o_orderkey", text.human_bytes(F.col("n")).alias("size"), text.human_elapsed(F.col("s")).alias("elapsed"), F.round(text.rate_mib(F.col("n"), F.col("s")), 6).alias("rate"), text.plural(F.col("s") % 3, "file").alias("files"), text.truncated(F.concat(F.lit("key-"), F.col("n").cast("string")), 10).alias("short"), text.bar_cells(F.col("s"), F.lit(5000), 20).alias("cells"))


def q_issue_log(spark, sf_dir):
    issues = _t(spark, sf_dir, "events").select(F.col("event_type").alias("run"), "event_id")
    return diagnostics.throttled_log(issues, ["event_id"]).select("run", "event_id", F.col("n").cast("long").alias("n"))


def q_phase_plan(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    phases = d.groupBy("lang").agg(F.count("*").alias("planned_entries"), F.sum(F.col("doc_id") % 5).alias("planned_blocks"), F.sum(F.octet_length("text").cast("long")).alias("planned_bytes"))
    return diagnostics.planned_by_phase(phases)


def q_code_maps(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    each = e.groupBy("event_type", F.col("user_id").alias("sample")).agg(F.create_map(F.lit("SlowDown"), F.count_if(F.col("event_id") % 3 == 0), F.lit("Other"), F.count("*")).alias("failures_by_error_code"))
    merged = diagnostics.merge_code_maps(each, ["event_type"])
    return merged.select("event_type", F.explode("failures_by_error_code").alias("code", "n"))


def q_mutation_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(_path().alias("path"), F.octet_length("text").cast("long").alias("size"))
    return fixtures.mutation_stats(fixtures.mutate(rows, 0.05, 7))


def q_mutation_counts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 900).alias("n"), ((F.col("o_orderkey") % 101) / 100).alias("ratio"))
    return o.select("o_orderkey", fixtures.mutation_count(F.col("n"), F.col("ratio")).alias("changed"))


def q_bench_cases(spark, sf_dir):
    return fixtures.bench_cases(spark, ["small100", "streaming"], ["full", "update", "update_ignored"], [128, 256, 512], 3)


def q_bench_order(spark, sf_dir):
    """Cases in the order in which a report shows them."""
    return diagnostics.bench_order(q_bench_cases(spark, sf_dir))


def q_fixture_manifest(spark, sf_dir):
    """A manifest written as JSON and read again, and a mutated one beside it, by position."""
    rows = _t(spark, sf_dir, "documents").select(_path().alias("path"), F.col("lang").alias("kind"), F.col("source").alias("profile"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    changed = fixtures.mutate(rows, 0.05, 7).withColumn("original_sha256", F.col("sha256")).withColumn("sha256", F.when(F.col("changed"), F.sha2(F.concat("path", F.lit("new")), 256)).otherwise(F.col("sha256")))
    read = []
    for name, table in (("base", rows), ("mutated", changed)):
        folder = f"{scratch.folder(spark)}/fixture-{name}-{uuid.uuid4().hex}"
        fixtures.manifest_row(table, 1).write.json(folder)
        read.append(fixtures.manifest_entries(fixtures.read_manifest(spark, folder)))
    return fixtures.compare_by_position(*read).select("path", "size", "sha256", "changed", "differs")


def q_report_json(spark, sf_dir):
    """A report's rows as JSON without absent values, parsed again."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('a "quoted" '), F.col("event_type"))).alias("message"))
    found = reports.to_json_rows(rows).select("json", F.from_json("json", "event_id long, status string, message string").alias("r"))
    return found.select("r.event_id", "r.status", "r.message", F.col("json").contains("message").alias("has_message"))


def q_catalog_json(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(_path().alias("zip_path"), F.md5("text").alias("md5"))
    found = pack.catalog_json(rows).select(F.from_json("json", "version int, entries array<struct<path: string, md5: string>>").alias("c"))
    return found.select("c.version", F.posexplode("c.entries").alias("pos", "e")).select("version", "pos", "e.path", "e.md5")


def q_content_checks(spark, sf_dir):
    """Sizes and checksums that contents are held against."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("c"))
    size = F.octet_length("c").cast("long") + F.when(F.col("doc_id") % 4 == 1, -1).when(F.col("doc_id") % 4 == 2, 1).otherwise(0)
    rows = d.select("doc_id", "c", size.alias("size"), (F.crc32("c") + F.when(F.col("doc_id") % 8 == 3, 1).otherwise(0)).alias("crc"))
    return rows.select("doc_id", etags.content_error(F.col("c"), F.col("size"), F.col("crc")).alias("error"))


SQL = {
    "q_zip_manifest": f"WITH {_DOCS} SELECT archive, zip_path, CAST(strlen(body) AS BIGINT) AS size, TRUE AS has_span FROM docs",
    "q_zip_entries": f"WITH {_DOCS} SELECT zip_path, CAST(strlen(body) AS BIGINT) AS bytes, md5(body) AS md5 FROM docs",
    "q_read_planned_blocks": f"WITH {_DOCS} SELECT zip_path, md5(body) AS md5, CAST(NULL AS VARCHAR) AS error FROM docs WHERE lang = 'en'",
    "q_inspect_archives": f"WITH {_DOCS} SELECT archive, count(*) AS file_count, TRUE AS has_bytes FROM docs GROUP BY archive",
    "q_embedded_catalog": f"WITH {_DOCS} SELECT archive, zip_path, md5(body) AS catalog_md5 FROM docs",
    "q_live_sync": f"WITH {_DOCS} SELECT {_STATE} AS status, 'site/' || zip_path AS key, zip_path, CAST(strlen(body) AS BIGINT) AS size, md5(body) AS md5 FROM docs UNION ALL SELECT 'deleted_extra', 'site/extra/' || page_id, NULL, NULL, NULL FROM pages",
    "q_live_summary": f"""WITH {_DOCS}, s AS (SELECT {_STATE} AS status, count(*) AS n FROM docs GROUP BY 1), c AS (SELECT coalesce(sum(n) FILTER (status = 'uploaded_new'), 0) AS a, coalesce(sum(n) FILTER (status = 'uploaded_changed'), 0) AS b, coalesce(sum(n) FILTER (status = 'skipped_unchanged'), 0) AS k, sum(n) AS t FROM s)
      SELECT CAST(t AS BIGINT) AS zip_files, CAST(b + k + (SELECT count(*) FROM pages) AS BIGINT) AS destination_objects, CAST(a AS BIGINT) AS uploaded_new, CAST(b AS BIGINT) AS uploaded_changed, CAST(k AS BIGINT) AS skipped_unchanged, CAST(0 AS BIGINT) AS conditional_conflicts, (SELECT count(*) FROM pages) AS deleted_extra, CAST(0 AS BIGINT) AS errors FROM c""",
    "q_live_puts": f"WITH {_DOCS} SELECT count(*) AS attempts, CAST(0 AS BIGINT) AS failed_attempts, CAST(0 AS BIGINT) AS retry_attempts, CAST(0 AS BIGINT) AS throttled_attempts, CAST(0 AS BIGINT) AS codes FROM docs WHERE {_STATE} <> 'skipped_unchanged'",
    "q_live_planned": f"WITH {_DOCS} SELECT count(*) AS planned_entries, TRUE AS blocks_cover, TRUE AS has_bytes FROM docs WHERE {_STATE} <> 'skipped_unchanged'",
    "q_live_listing": f"WITH {_DOCS} SELECT 'site/' || zip_path AS key, md5(body) AS md5, CAST(strlen(body) AS BIGINT) AS size FROM docs UNION ALL SELECT DISTINCT 'site/extra/', NULL, CAST(0 AS BIGINT) FROM pages",
    "q_live_resync": f"WITH {_DOCS} SELECT count(*) AS zip_files, count(*) + (SELECT count(*) FROM (SELECT 1 FROM pages LIMIT 1)) AS destination_objects, CAST(0 AS BIGINT) AS uploaded_new, CAST(0 AS BIGINT) AS uploaded_changed, count(*) AS skipped_unchanged, CAST(0 AS BIGINT) AS conditional_conflicts, CAST(0 AS BIGINT) AS deleted_extra, CAST(0 AS BIGINT) AS errors, unnest([TRUE, FALSE]) AS catalog FROM docs",
    "q_live_tree": f"WITH {_DOCS} SELECT zip_path, CAST(strlen(body) AS BIGINT) AS size, 'file' AS kind FROM docs UNION ALL SELECT DISTINCT 'extra/', CAST(0 AS BIGINT), 'directory' FROM pages",
    "q_extract_local": f"WITH {_DOCS} SELECT 'uploaded_changed' AS status, zip_path, CAST(strlen(body) AS BIGINT) AS size FROM docs",
    "q_pack_folder": f"WITH {_DOCS}, e AS (SELECT count(*) AS n FROM (SELECT 1 FROM pages LIMIT 1)) SELECT count(*) AS files, (SELECT n FROM e) AS directories, count(*) + (SELECT n FROM e) AS entries, CAST(sum(strlen(body)) AS BIGINT) AS total_bytes, count(*) AS file_count FROM docs",
    "q_prepared_entries": f"WITH {_DOCS} SELECT zip_path, 'site/x/' || zip_path AS key, FALSE AS is_directory, CAST(strlen(text) AS BIGINT) AS size FROM docs WHERE doc_id % 50 <> 1 AND doc_id % 7 <> 0",
    "q_entry_errors": "SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'directory entry has content' WHEN 3 THEN 'unsupported compression method' WHEN 5 THEN 'entry too large' END AS error FROM pages",
    "q_selection_dialect": f"WITH {_DOCS} SELECT doc_id, zip_path FROM docs WHERE (lang LIKE 'e_' OR (regexp_full_match(lang, 'd[a-e]') AND regexp_full_match(source, 'src[^0-4]'))) AND doc_id % 10 <> 1",
    "q_listing_to_tree": "SELECT CASE WHEN page_id % 9 = 0 THEN page_id || '/' ELSE page_id || '.html' END AS zip_path, CAST(CASE WHEN page_id % 9 = 0 THEN 0 ELSE strlen(html) END AS BIGINT) AS size, CASE WHEN page_id % 9 = 0 THEN 'directory' ELSE 'file' END AS kind, 'a/b/' || CASE WHEN page_id % 9 = 0 THEN page_id || '/' ELSE page_id || '.html' END AS key FROM pages",
    "q_key_errors": """WITH k AS (SELECT page_id, page_id % 2 AS size, page_id % 7 AS v, ['p/ok', 'q/no', 'p/', 'p/d/', 'p/../x', 'p/a//b', 'p//'][page_id % 7 + 1] AS key FROM pages)
      SELECT page_id, key, 'p/' AS head, CASE WHEN v <> 1 THEN substr(key, 3) END AS path, CASE v WHEN 1 THEN 'key is outside the source prefix' WHEN 2 THEN CASE WHEN size <> 0 THEN 'source prefix root object cannot be an archive entry' END
      WHEN 3 THEN CASE WHEN size <> 0 THEN 'trailing-slash objects must be zero-byte directory markers' END WHEN 4 THEN 'relative path component' WHEN 5 THEN 'empty path component' WHEN 6 THEN 'absolute path' END AS error FROM k""",
    "q_span_bounds": "SELECT event_id, CASE WHEN event_id * 13 % 1000 >= 900 THEN 'entry starts beyond the archive' WHEN event_id * 13 % 1000 >= 800 THEN 'entry starts beyond the central directory' WHEN event_id * 7 % 1100 <= event_id * 13 % 1000 THEN 'entry span is empty' END AS error FROM events",
    "q_request_errors": """WITH r AS (SELECT event_id, [200, 409, 412, 500, NULL][event_id % 5 + 1] AS status, ['SlowDown', 'PreconditionFailed', NULL, 'ConditionalRequestConflict'][event_id % 4 + 1] AS code, ['s3', 'io', 'zip'][event_id % 3 + 1] AS kind, ['invalid_data', 'timed out', NULL, 'invalid_input', 'reset', NULL, 'eof'][event_id % 7 + 1] AS io_kind, CASE WHEN event_id % 2 = 0 THEN event_type END AS message FROM events)
      SELECT event_id, coalesce(status IN (409, 412), FALSE) OR coalesce(code IN ('PreconditionFailed', 'ConditionalRequestConflict'), FALSE) AS conflict, kind = 's3' OR (kind = 'io' AND coalesce(io_kind NOT IN ('invalid_data', 'invalid_input'), TRUE)) AS retryable,
      coalesce(code, replace(io_kind, ' ', '_')) AS failure, CASE WHEN code IS NOT NULL AND message IS NOT NULL THEN code || ': ' || message ELSE coalesce(code, message, kind) END AS text FROM r""",
    "q_local_names": r"""WITH n AS (SELECT page_id, coalesce(regexp_extract(url, '://([^?#]*)', 1), '') AS name FROM pages)
      SELECT page_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS swapped, '/out/' || rtrim(name, '/') AS target,
      name <> '' AND NOT regexp_matches(name, '^/|\\|(^|/)(|[.]|[.][.])(/|$)|^[A-Za-z]:') AS safe FROM n""",
    "q_text_formats": """WITH o AS (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS n, o_orderkey % 5000 AS s FROM orders)
      SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:,.1f} KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:,.1f} MiB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN format('{:,.1f} GiB', n / 1073741824.0::DOUBLE) ELSE format('{:,.1f} TiB', n / 1099511627776.0::DOUBLE) END AS size,
      format('{:02d}:{:02d}', s // 60, s % 60) AS elapsed, coalesce(round(CASE WHEN s = 0 THEN NULL ELSE n / 1048576.0::DOUBLE / s END, 6), 0) AS rate, (s % 3) || CASE WHEN s % 3 = 1 THEN ' file' ELSE ' files' END AS files,
      CASE WHEN length('key-' || n) <= 10 THEN 'key-' || n ELSE substr('key-' || n, 1, 9) || '…' END AS short, CAST(floor(s * 20 / 5000) AS BIGINT) AS cells FROM o""",
    "q_issue_log": "SELECT run, event_id, n FROM (SELECT event_type AS run, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 20 OR n % 100 = 0",
    "q_phase_plan": "SELECT count(*) AS planned_entries, CAST(sum(doc_id % 5) AS BIGINT) AS planned_blocks, CAST(sum(strlen(text)) AS BIGINT) AS planned_bytes FROM documents",
    "q_code_maps": "SELECT event_type, unnest(['SlowDown', 'Other']) AS code, unnest([count(*) FILTER (event_id % 3 = 0), count(*)]) AS n FROM events GROUP BY event_type",
    "q_mutation_stats": f"WITH {_DOCS}, r AS (SELECT strlen(text) AS size, row_number() OVER (ORDER BY md5('7:' || zip_path), zip_path) AS rn, count(*) OVER () AS n FROM docs) SELECT count(*) FILTER (rn <= ceil(n * 5 / 100)) AS changed_files, count(*) FILTER (rn > ceil(n * 5 / 100)) AS unchanged_files, CAST(coalesce(sum(size) FILTER (rn <= ceil(n * 5 / 100)), 0) AS BIGINT) AS changed_bytes FROM r",
    "q_mutation_counts": "SELECT o_orderkey, CAST(least(ceil((o_custkey % 900) * ((o_orderkey % 101) / 100::DOUBLE)), o_custkey % 900) AS BIGINT) AS changed FROM orders",
    "q_bench_cases": "SELECT fixture, run, memory_mb, sample FROM (VALUES ('small100'), ('streaming')) f(fixture), (VALUES ('full'), ('update'), ('update_ignored')) r(run), (VALUES (128), (256), (512)) m(memory_mb), (VALUES (0), (1), (2)) s(sample)",
    "q_bench_order": "SELECT fixture, run, memory_mb, sample, row_number() OVER (ORDER BY memory_mb, fixture, CASE run WHEN 'full' THEN 0 WHEN 'update' THEN 1 ELSE 2 END, sample) AS place FROM (VALUES ('small100'), ('streaming')) f(fixture), (VALUES ('full'), ('update'), ('update_ignored')) r(run), (VALUES (128), (256), (512)) m(memory_mb), (VALUES (0), (1), (2)) s(sample)",
    "q_fixture_manifest": f"""WITH {_DOCS}, r AS (SELECT zip_path AS path, strlen(text) AS size, sha256(text) AS h, row_number() OVER (ORDER BY md5('7:' || zip_path), zip_path) <= ceil(count(*) OVER () * 5 / 100) AS changed FROM docs)
      SELECT path, CAST(size AS BIGINT) AS size, CASE WHEN changed THEN sha256(path || 'new') ELSE h END AS sha256, changed, changed AS differs FROM r""",
    "q_report_json": """SELECT event_id, event_type AS status, CASE WHEN event_id % 3 = 0 THEN 'a "quoted" ' || event_type END AS message, event_id % 3 = 0 AS has_message FROM events""",
    "q_catalog_json": f"WITH {_DOCS} SELECT CAST(1 AS INTEGER) AS version, CAST(row_number() OVER (ORDER BY zip_path, md5(text)) - 1 AS INTEGER) AS pos, zip_path AS path, md5(text) AS md5 FROM docs",
    "q_content_checks": "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'entry produced more bytes than declared' WHEN doc_id % 4 = 2 THEN 'entry produced fewer bytes than declared' WHEN doc_id % 8 = 3 THEN 'CRC32 mismatch' END AS error FROM documents",
}


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("q_")}
