"""Registered queries over the driver's tables, one or more for each operator, and their SQL.

``documents`` plays the entries of one archive per source, and a destination listing is derived
from it; ``pages`` gives extra objects and raw paths; ``events`` gives read and write attempts.
Each derived view is stated twice, as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import live_queries
from sheaf.functions import etags, paths, text, tuning
from sheaf.operators import checks, diagnostics, economics, fixtures, intervals, ranges, selection, spans
from sheaf.plans import pack, sync
from sheaf.plans.options import SyncOptions

DRY_DELETE = SyncOptions(prefix="site", delete_extra=True, dry_run=True)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived views ----------------------------------------------------------------------------


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive entry per document, and a directory marker per language."""
    d = _t(spark, sf_dir, "documents")
    files = d.select(
        F.col("source").alias("archive"), "doc_id", F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".txt"))).alias("zip_path"), F.lit(False).alias("is_directory"),
        F.octet_length("text").cast("long").alias("size"), F.md5("text").alias("md5"), F.when(F.col("doc_id") % 4 != 1, F.md5("text")).alias("catalog_md5"),
    )
    marks = d.select("lang").distinct().select(
        F.lit("marks").alias("archive"), F.lit(-1).cast("long").alias("doc_id"), F.concat("lang", F.lit("/")).alias("zip_path"), F.lit(True).alias("is_directory"),
        F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("md5"), F.lit(None).cast("string").alias("catalog_md5"),
    )
    return files.unionByName(marks).withColumn("key", paths.join_key(F.lit("site"), F.col("zip_path")))


ENTRIES = """entries AS (
  SELECT source AS archive, doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS zip_path, FALSE AS is_directory, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5,
    CASE WHEN doc_id % 4 <> 1 THEN md5(text) END AS catalog_md5, 'site/' || lang || '/' || source || '/' || doc_id || '.txt' AS key FROM documents
  UNION ALL
  SELECT DISTINCT 'marks', CAST(-1 AS BIGINT), lang || '/', TRUE, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'site/' || lang || '/' FROM documents)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the destination holds: most documents, some of them changed, markers and extras."""
    d = _t(spark, sf_dir, "documents").where("doc_id % 10 <> 3")
    changed = F.md5(F.when(F.col("doc_id") % 20 < 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    tag = F.when(F.col("doc_id") % 23 == 7, F.lit(None)).when(F.col("doc_id") % 17 == 5, F.concat(F.lit('"'), changed, F.lit('-2"'))).otherwise(F.concat(F.lit('"'), F.upper(changed), F.lit('"')))
    size = F.octet_length("text") + F.when(F.col("doc_id") % 19 == 2, 1).otherwise(0)
    files = d.select(F.concat_ws("/", F.lit("site"), "lang", "source", F.concat("doc_id", F.lit(".txt"))).alias("key"), tag.alias("etag"), size.cast("long").alias("size"))
    langs = _t(spark, sf_dir, "documents").select("lang").distinct().where("lang <> 'en'")
    marker = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 5).cast("long")
    marks = langs.select(F.concat(F.lit("site/"), F.col("lang"), F.lit("/")).alias("key"), F.lit(None).cast("string").alias("etag"), marker.alias("size"))
    extra = _t(spark, sf_dir, "pages").select(F.concat(F.lit("site/extra/"), F.col("page_id")).alias("key"), F.concat(F.lit('"'), F.md5("url"), F.lit('"')).alias("etag"), F.octet_length("html").cast("long").alias("size"))
    return files.unionByName(marks).unionByName(extra)


LISTING = """listing AS (
  SELECT 'site/' || lang || '/' || source || '/' || doc_id || '.txt' AS key,
    CASE WHEN doc_id % 23 = 7 THEN NULL WHEN doc_id % 17 = 5 THEN '"' || m || '-2"' ELSE '"' || upper(m) || '"' END AS etag,
    CAST(strlen(text) + CASE WHEN doc_id % 19 = 2 THEN 1 ELSE 0 END AS BIGINT) AS size
  FROM (SELECT *, md5(CASE WHEN doc_id % 20 < 2 THEN text || 'x' ELSE text END) AS m FROM documents WHERE doc_id % 10 <> 3)
  UNION ALL
  SELECT DISTINCT 'site/' || lang || '/', CAST(NULL AS VARCHAR), CAST(CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 5 END AS BIGINT) FROM documents WHERE lang <> 'en'
  UNION ALL
  SELECT 'site/extra/' || page_id, '"' || md5(url) || '"', CAST(strlen(html) AS BIGINT) FROM pages)"""

NORMAL = r"""CASE WHEN regexp_full_match(lower(trim(trim({0}), '"')), '[0-9a-f]{{32}}') THEN lower(trim(trim({0}), '"')) END"""


def _classified(local: bool, dry: bool, catalog: bool) -> str:
    """SQL of the decision table, up to resolved operations (CTE ``ops``)."""
    cat = "catalog_md5" if catalog else "CAST(NULL AS VARCHAR)"
    in_cat = "cmd5 = tag" + (" AND (lsize IS NULL OR lsize = size)" if local else "")
    no_tag = "'upload_new'" if local and not dry else "'error_tag'"
    by_cat = "" if local else "WHEN cmd5 IS NOT NULL THEN 'upload_changed'"
    error_md5 = "cmd5" if local else "NULL"
    names = {k: v if dry else k for k, v in diagnostics.DRY.items()}
    return f"""joined AS (SELECT e.*, {cat} AS cmd5, l.etag, l.size AS lsize, l.key IS NOT NULL AS listed, {NORMAL.format('l.etag')} AS tag FROM entries e LEFT JOIN listing l ON e.key = l.key),
decided AS (SELECT *, CASE
    WHEN is_directory AND NOT listed THEN 'upload_new' WHEN is_directory AND lsize = 0 THEN 'skip_dir'
    WHEN is_directory AND lsize IS NOT NULL THEN 'error_size' WHEN is_directory THEN 'error_nosize'
    WHEN {in_cat} THEN 'skip_catalog' WHEN NOT listed THEN 'upload_new' WHEN etag IS NULL THEN {no_tag} {by_cat}
    WHEN (lsize IS NULL OR lsize = size) AND tag IS NOT NULL THEN CASE WHEN md5 = tag THEN 'skip_hash' ELSE 'upload_hash' END
    ELSE 'upload_changed' END AS d FROM joined),
ops AS (SELECT CASE WHEN d LIKE 'skip%' THEN '{names["skipped_unchanged"]}' WHEN d LIKE 'error%' THEN '{names["error"]}' WHEN d = 'upload_new' THEN '{names["uploaded_new"]}' ELSE '{names["uploaded_changed"]}' END AS status,
    key, zip_path, size, CASE d WHEN 'skip_dir' THEN '{etags.EMPTY_MD5}' WHEN 'error_size' THEN NULL WHEN 'error_nosize' THEN NULL WHEN 'error_tag' THEN {error_md5} WHEN 'skip_hash' THEN md5 WHEN 'upload_hash' THEN md5 ELSE cmd5 END AS md5,
    etag AS destination_etag,
    CASE d WHEN 'error_size' THEN 'directory marker exists with nonzero size ' || lsize WHEN 'error_nosize' THEN 'directory marker is listed without a size' WHEN 'error_tag' THEN 'destination object was listed without an ETag' END AS message FROM decided)"""


def _plan_sql(select: str, local: bool = False, dry: bool = False, catalog: bool = True) -> str:
    return f"WITH {ENTRIES}, {LISTING}, {_classified(local, dry, catalog)} {select}"


def _digests(e: DataFrame) -> DataFrame:
    return e.where(~F.col("is_directory")).select("key", "md5")


def _planned(spark, sf_dir, opts: SyncOptions) -> DataFrame:
    e = entries(spark, sf_dir)
    return sync.plan_sync(e, listing(spark, sf_dir), _digests(e), opts)


# --- synchronisation --------------------------------------------------------------------------


def q_plan_sync(spark, sf_dir):
    return _planned(spark, sf_dir, SyncOptions(prefix="site"))


def q_plan_sync_local_profile(spark, sf_dir):
    return _planned(spark, sf_dir, SyncOptions(prefix="site", profile="local_zip"))


def q_plan_sync_ignore_catalog(spark, sf_dir):
    return _planned(spark, sf_dir, SyncOptions(prefix="site", use_catalog=False))


def q_plan_sync_dry_delete(spark, sf_dir):
    return _planned(spark, sf_dir, DRY_DELETE)


def q_sync_summary(spark, sf_dir):
    ops = _planned(spark, sf_dir, SyncOptions(prefix="site", delete_extra=True))
    return diagnostics.sync_summary(ops, entries(spark, sf_dir), listing(spark, sf_dir))


def q_dryrun_summary(spark, sf_dir):
    return diagnostics.dry_summary(_planned(spark, sf_dir, DRY_DELETE), entries(spark, sf_dir), listing(spark, sf_dir))


def q_delete_extra(spark, sf_dir):
    return sync.delete_extra(listing(spark, sf_dir), entries(spark, sf_dir), dry=True).select("key", "size", "destination_etag")


def q_hash_phase(spark, sf_dir):
    e = entries(spark, sf_dir)
    plan = sync.classify(e, listing(spark, sf_dir), SyncOptions(prefix="site")).where("action = 'hash'")
    return sync.hash_phase(plan, _digests(e)).select("key", "action", F.col("md5_out").alias("md5"), "comparison_md5")


def q_catalog_join(spark, sf_dir):
    e = entries(spark, sf_dir)
    catalog = e.where("catalog_md5 is not null").groupBy(F.lit(1).alias("version"), "archive").agg(F.collect_list(F.struct(F.col("zip_path").alias("path"), F.upper("catalog_md5").alias("md5"))).alias("entries"))
    return sync.join_catalog(e.where(~F.col("is_directory")), sync.catalog_entries(catalog, paths.CATALOG_PATH)).select("zip_path", "catalog_md5")


def q_plan_local(spark, sf_dir):
    e = entries(spark, sf_dir)
    there = e.where("doc_id % 3 = 0").select("zip_path", "is_directory").unionByName(e.where("doc_id % 29 = 1").select(F.concat("zip_path", F.lit("/")).alias("zip_path"), F.lit(True).alias("is_directory")))
    return sync.plan_local(e, there).select("status", "zip_path", "message")


# --- paths, tags and selection ----------------------------------------------------------------

#: Raw path variants around a page's host, by page_id % 10.
VARIANTS = ("{h}/index.html", "/abs/{h}", "a//{h}", "../{h}", "C:/{h}", "a\\{h}", "dir/{h}/", "", ".", "//")


def _raw_paths(spark, sf_dir) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    raw = None
    for i, v in enumerate(VARIANTS):
        head, _, tail = v.partition("{h}")
        value = F.concat(F.lit(head), host, F.lit(tail)) if "{h}" in v else F.lit(v)
        raw = F.when(F.col("page_id") % 10 == i, value) if raw is None else raw.when(F.col("page_id") % 10 == i, value)
    return _t(spark, sf_dir, "pages").select("page_id", raw.alias("raw_path"))


_RAW = "raw AS (SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN " + " || ".join(f"'{p}'" if p != "{h}" else "regexp_extract(url, '://([^/?#]*)', 1)" for p in v.replace("{h}", "\0{h}\0").split("\0")) for i, v in enumerate(VARIANTS)) + " END AS raw_path FROM pages)"


def q_path_validation(spark, sf_dir):
    raw = F.col("raw_path")
    return _raw_paths(spark, sf_dir).select("page_id", "raw_path", paths.normalized_path(raw).alias("zip_path"), paths.is_directory(raw).alias("is_directory"), paths.path_error(raw).alias("error"))


def q_local_component_safety(spark, sf_dir):
    mark = F.element_at(F.array(*[F.lit(x) for x in ("ok.txt", "con", "a:b", "end.", "Lpt1.log", "x?y", "com10", "nul .txt")]), (F.col("page_id") % 8 + 1).cast("int"))
    df = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("site/"), mark, F.lit("/f")).alias("path"))
    return df.select("page_id", "path", paths.unsafe_local_path(F.col("path")).alias("unsafe"))


def q_s3_uri_parse(spark, sf_dir):
    uri = F.regexp_replace(F.regexp_replace("url", "^https?://m\\.", "s3:///"), "^https?://(www\\.)?", "s3://")
    df = _t(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.col("url")).otherwise(uri).alias("uri"))
    p = paths.object_uri(F.col("uri"))
    return df.select("page_id", p["bucket"].alias("bucket"), p["key"].alias("key"), p["error"].alias("error"))


def q_normalize_etag(spark, sf_dir):
    return listing(spark, sf_dir).select("key", etags.normalize_etag(F.col("etag")).alias("md5"))


def _picked(spark, sf_dir, s: selection.Selection) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.where(selection.selected(F.col("zip_path"), s)).select("zip_path")


def q_selection_include_exclude(spark, sf_dir):
    return _picked(spark, sf_dir, selection.Selection().include("en/**").include("/de/src1").exclude("*7.txt").include("src3/").exclude("en/src2/"))


def q_selection_exclude_only(spark, sf_dir):
    return _picked(spark, sf_dir, selection.Selection().exclude("fr/**").exclude("src[0-4]/"))


# --- spans, blocks and intervals --------------------------------------------------------------


def _spans(spark, sf_dir) -> DataFrame:
    """Header offsets as a running sum within the archive; every eleventh repeats the one before."""
    from pyspark.sql.window import Window

    e = entries(spark, sf_dir).where(~F.col("is_directory"))
    length = F.col("size") + 30 + F.octet_length("zip_path")
    keys = ["archive"]
    e = ranges.ranged(e.withColumn("_length", length), keys, ["doc_id"])
    e = ranges.with_carry(e, keys, F.sum("_length"), lambda c: F.sum(c).over(ranges.earlier(keys)), "_before")
    e = ranges.with_carry(e, keys, F.sum("_length"), lambda c: F.sum(c).over(Window.partitionBy(*keys)), "cd_start")
    order = ranges.within(keys, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return e.withColumn("header_offset", F.coalesce(F.sum("_length").over(order), zero) + F.coalesce("_before", zero)).drop("_length", "_before", ranges.PART)


_SPANS = """spans AS (SELECT archive, doc_id, zip_path, size,
  CAST(coalesce(sum(size + 30 + strlen(zip_path)) OVER (PARTITION BY archive ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS header_offset,
  CAST(sum(size + 30 + strlen(zip_path)) OVER (PARTITION BY archive) AS BIGINT) AS cd_start FROM entries WHERE NOT is_directory)"""


def q_manifest_spans(spark, sf_dir):
    coarse = _spans(spark, sf_dir).withColumn("header_offset", tuning.align_down(F.col("header_offset"), 4096))
    return spans.span_ends(coarse).select("archive", "zip_path", F.col("header_offset").alias("span_start"), "span_end")


BLOCK, GAP = 16384, 2048


def _needed(spark, sf_dir) -> DataFrame:
    """Spans of the entries whose bytes the plan needs, to be hashed or uploaded."""
    e = entries(spark, sf_dir)
    plan = sync.classify(e, listing(spark, sf_dir), SyncOptions(prefix="site")).where("action in ('hash', 'upload')")
    df = spans.span_ends(_spans(spark, sf_dir)).join(plan.select("key"), "key", "left_semi")
    return df.select("archive", "zip_path", F.col("header_offset").alias("start"), F.col("span_end").alias("end"))


def q_block_plan(spark, sf_dir):
    return spans.plan_blocks(_needed(spark, sf_dir), block_size=BLOCK, merge_gap=GAP)


def q_block_claims(spark, sf_dir):
    needed = _needed(spark, sf_dir)
    return spans.block_claims(spans.plan_blocks(needed, block_size=BLOCK, merge_gap=GAP), needed, step=BLOCK)


def q_point_to_block(spark, sf_dir):
    needed = _needed(spark, sf_dir)
    blocks = spans.plan_blocks(needed, block_size=BLOCK, merge_gap=GAP)
    points = _spans(spark, sf_dir).select("archive", "zip_path", (F.col("header_offset") + 30).alias("offset"))
    return spans.point_to_block(points, blocks)


_NEEDED = f"""{_SPANS},
needed AS (SELECT archive, zip_path, header_offset AS start, end_ AS "end", row_number() OVER (PARTITION BY archive ORDER BY header_offset, end_) AS rn
  FROM (SELECT *, coalesce(lead(header_offset) OVER (PARTITION BY archive ORDER BY header_offset), cd_start) AS end_ FROM spans) WHERE 'site/' || zip_path IN (SELECT key FROM decided WHERE d IN ('upload_new', 'upload_changed', 'upload_hash', 'skip_hash'))),
fold AS (
  SELECT archive, rn, start AS b0, "end" AS b1, CAST(1 AS BIGINT) AS block FROM needed WHERE rn = 1
  UNION ALL
  SELECT n.archive, n.rn,
    CASE WHEN n.start - f.b1 <= {GAP} AND greatest(f.b1, n."end") - f.b0 <= {BLOCK} THEN f.b0 ELSE n.start END,
    CASE WHEN n.start - f.b1 <= {GAP} AND greatest(f.b1, n."end") - f.b0 <= {BLOCK} THEN greatest(f.b1, n."end") ELSE n."end" END,
    CASE WHEN n.start - f.b1 <= {GAP} AND greatest(f.b1, n."end") - f.b0 <= {BLOCK} THEN f.block ELSE f.block + 1 END
  FROM fold f JOIN needed n ON n.archive = f.archive AND n.rn = f.rn + 1),
merged AS (SELECT archive, block, min(b0) AS b0, max(b1) AS b1 FROM fold GROUP BY archive, block),
pieces AS (SELECT archive, b1, unnest(generate_series(b0, b1 - 1, {BLOCK})) AS p FROM merged),
blocks AS (SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY p, least(p + {BLOCK}, b1)) AS BIGINT) AS block_id, CAST(p AS BIGINT) AS start, CAST(least(p + {BLOCK}, b1) - 1 AS BIGINT) AS "end" FROM pieces)"""


def _gets(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    start = F.col("event_id") * 37 % 100000
    return e.select("event_type", "event_id", (F.col("event_id") % 7 != 0).alias("ok"), (F.col("event_id") % 3 + 1).alias("attempt"), start.alias("start"), (start + F.floor("value")).cast("long").alias("end"))


_GETS = """gets AS (SELECT event_type, event_id, event_id % 7 <> 0 AS ok, event_id % 3 + 1 AS attempt, event_id * 37 % 100000 AS start, CAST(event_id * 37 % 100000 + floor(value) AS BIGINT) AS "end" FROM events)"""
_UNION = """parts AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS part FROM
  (SELECT *, max("end") OVER (PARTITION BY event_type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0} WHERE "end" >= start)),
islands AS (SELECT event_type, min(start) AS i0, max("end") AS i1 FROM parts GROUP BY event_type, part),
uniq AS (SELECT event_type, CAST(sum(i1 - i0 + 1) AS BIGINT) AS unique_bytes FROM islands GROUP BY event_type),
fetched AS (SELECT event_type, CAST(sum("end" - start + 1) AS BIGINT) AS fetched_bytes FROM {0} WHERE "end" >= start GROUP BY event_type)"""


def q_interval_union(spark, sf_dir):
    out = intervals.fetch_measures(_gets(spark, sf_dir), ["event_type"])
    return out.withColumn("source_amplification", F.round("source_amplification", 6))


def q_source_diagnostics(spark, sf_dir):
    out = diagnostics.source_diagnostics(_gets(spark, sf_dir), ["event_type"])
    return out.withColumn("source_amplification", F.round("source_amplification", 6))


def q_high_water(spark, sf_dir):
    return intervals.high_water(_gets(spark, sf_dir).where("end > start"), ["event_type"], "start", "end")


# --- retries, sizing and reports --------------------------------------------------------------


def _puts(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("event_id") % 5 == 0, "SlowDown").when(F.col("event_id") % 7 == 0, "PreconditionFailed").when(F.col("event_id") % 11 == 0, F.concat(F.lit("x_"), F.col("event_type")))
    return _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6 + 1).alias("attempt"), code.alias("error_code"))


_PUTS = "puts AS (SELECT event_id, event_id % 6 + 1 AS attempt, CASE WHEN event_id % 5 = 0 THEN 'SlowDown' WHEN event_id % 7 = 0 THEN 'PreconditionFailed' WHEN event_id % 11 = 0 THEN 'x_' || event_type END AS error_code FROM events)"


def q_put_failures_by_code(spark, sf_dir):
    return diagnostics.put_failures(_puts(spark, sf_dir))


def q_retry_backoff(spark, sf_dir):
    throttled = tuning.is_throttle(F.col("error_code"))
    return _puts(spark, sf_dir).select("event_id", "attempt", tuning.backoff_ms(F.col("attempt"), throttled).alias("delay_ms"))


def q_adaptive_window(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, (128, 256, 512, 1024, 2048, 3008))), (F.col("o_orderkey") % 6 + 1).cast("int")).cast("long").alias("memory_mb"), (F.col("o_totalprice") * 5000).cast("long").alias("zip_bytes"), (F.col("o_custkey") * 40).alias("files"))
    workers = tuning.worker_count(F.col("memory_mb"))
    gets = tuning.get_concurrency(F.col("memory_mb"))
    return o.select("o_orderkey", workers.alias("workers"), gets.alias("gets"), tuning.put_count(workers).alias("puts"), tuning.adaptive_window(F.col("memory_mb"), F.col("zip_bytes"), F.col("files"), workers, gets).alias("window_bytes"))


def q_multipart_parts(spark, sf_dir):
    objects = _t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return spans.multipart_parts(objects, part_size=1024).select("doc_id", "part_number", "part_start", "part_bytes")


def q_pack_report(spark, sf_dir):
    e = entries(spark, sf_dir)
    return pack.pack_report(e.withColumn("kind", F.when(F.col("is_directory"), "directory").otherwise("file")))


def q_pack_progress(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("kind", F.when(F.col("is_directory"), "directory").otherwise("file"))
    return pack.pack_progress(e, 65536).select("archive", "zip_path", "processed_files", "processed_bytes", "emits")


def q_duplicates(spark, sf_dir):
    return checks.duplicates(entries(spark, sf_dir).where(~F.col("is_directory")), ["md5"])


def q_path_collisions(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    path = F.when(F.col("page_id") % 50 == 0, host).when(F.col("page_id") % 50 == 1, F.upper(F.concat(host, F.lit("/a/")))).otherwise(F.concat_ws("/", host, F.lit("p"), F.col("page_id").cast("string")))
    df = p.select(path.alias("zip_path")).distinct().withColumn("is_directory", F.col("zip_path").endswith("/"))
    return checks.path_collisions(df, ignore_case=True)


def q_bench_aggregate(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    samples = li.select((F.col("l_linenumber") * 128).cast("long").alias("memory_mb"), F.col("l_returnflag").alias("fixture"), F.col("l_linestatus").alias("run"), F.lit("catalog").alias("catalog"), (F.col("l_quantity") > 5).alias("ok"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_quantity").alias("max_memory_used_mb"))
    return diagnostics.bench_aggregate(samples)


def q_fixture_classes(spark, sf_dir):
    e = entries(spark, sf_dir).where(~F.col("is_directory"))
    return fixtures.class_stats(e.withColumn("kind", F.when(F.col("doc_id") % 5 < 2, "compressible").when(F.col("doc_id") % 5 < 4, "incompressible").otherwise("mixed")), "kind")


def q_mutate_5pct(spark, sf_dir):
    e = entries(spark, sf_dir).where(~F.col("is_directory"))
    return fixtures.mutate(e, 0.05, 7, "zip_path").where("changed").select("zip_path")


def q_economics(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    corpora = d.groupBy(F.col("source").alias("corpus")).agg((F.count("*") * 100000).alias("objects"), (F.pow(F.lit(2.0), F.min("doc_id") % 5 * 2 + 3)).alias("avg_kib"), F.lit(0.1).alias("access"))
    return economics.storage_costs(corpora).withColumn("usd_month", F.round("usd_month", 3))


def q_parse_size(spark, sf_dir):
    o = _t(spark, sf_dir, "part")
    unit = F.element_at(F.array(*map(F.lit, ("", "KB", "KiB", "MiB", "k", "GB", "x"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    df = o.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit).alias("size_text"))
    return df.select("p_partkey", "size_text", text.parse_size(F.col("size_text")).alias("bytes"))


def q_report_lines(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 4 == 0, F.lit("START")).otherwise(F.format_string("REPORT RequestId: r%d\tDuration: %d.25 ms\tBilled Duration: %d ms\tMemory Size: 256 MB\tMax Memory Used: %d MB", F.col("event_id"), F.col("event_id"), F.col("event_id") + 1, F.col("user_id")))
    p = text.report_line(F.col("line"))
    return e.select("event_id", line.alias("line")).select("event_id", *[c.alias(n) for n, c in p.items()])


def q_generated_fixture(spark, sf_dir):
    return fixtures.generate(spark, _t(spark, sf_dir, "documents").count(), 10_000_000)


def q_zip_roundtrip(spark, sf_dir):
    from sheaf.sources import roundtrip

    return roundtrip.pages_roundtrip(spark, _t(spark, sf_dir, "pages"))


_OPS = "SELECT status, key, zip_path, size, md5, destination_etag, message FROM ops"
_DELETED = """SELECT 'would_delete_extra' AS status, key, CAST(NULL AS VARCHAR) AS zip_path, size, CAST(NULL AS VARCHAR) AS md5, etag AS destination_etag, CAST(NULL AS VARCHAR) AS message FROM listing WHERE key NOT IN (SELECT key FROM entries)"""
_COUNT = lambda s, name: f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {name}"
_TOTALS = "(SELECT count(*) FROM entries) AS zip_files, (SELECT count(*) FROM listing) AS destination_objects"


def _fixture_sql() -> str:
    """The generated tree: places by a permutation, shares by whole-number largest remainders.

    The permutation's step depends on the number of files only; SQL finds it as the operator does.
    """
    profiles = [(kind, n, p, suffix, w, name, folders) for kind in fixtures.PROFILES for n, (p, suffix, w, name, folders) in enumerate(fixtures.PROFILES[kind])]
    rows = ", ".join(f"({k}, '{kind}', {share}, {n}, '{p}', '{suffix}', {w}, '{name}', {list(folders)})" for kind, n, p, suffix, w, name, folders in profiles for k, (name_, share) in enumerate(fixtures.KINDS) if name_ == kind)
    return f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), step(s) AS (SELECT (2654435761 + 40503) % greatest(1, n) FROM n UNION ALL SELECT s + 1 FROM step, n WHERE gcd(s, n) <> 1),
      prof(k, kind, kshare, o, profile, suffix, pw, name, folders) AS (VALUES {rows}),
      k0 AS (SELECT DISTINCT k, kind, kshare, n * kshare AS raw FROM prof, n), k1 AS (SELECT *, floor(raw) AS f, row_number() OVER (ORDER BY raw - floor(raw) DESC, kshare DESC, k) AS r FROM k0),
      k2 AS (SELECT k, CAST(f + CASE WHEN r <= (SELECT n FROM n) - (SELECT sum(f) FROM k1) THEN 1 ELSE 0 END AS BIGINT) AS kn FROM k1),
      p0 AS (SELECT prof.*, kn, kn * pw / CAST(sum(pw) OVER (PARTITION BY k) AS DOUBLE) AS raw FROM prof JOIN k2 USING (k)),
      p1 AS (SELECT *, floor(raw) AS f, row_number() OVER (PARTITION BY k ORDER BY raw - floor(raw) DESC, pw DESC, o) AS r, sum(floor(raw)) OVER (PARTITION BY k) AS fs FROM p0),
      p2 AS (SELECT *, CAST(f + CASE WHEN r <= kn - fs THEN 1 ELSE 0 END AS BIGINT) AS m FROM p1),
      p3 AS (SELECT *, CAST(sum(m) OVER (ORDER BY k, o) - m AS BIGINT) AS first FROM p2 WHERE m > 0),
      i0 AS (SELECT unnest(range(0, n)) AS i, n FROM n),
      i1 AS (SELECT i, n, (i * (SELECT max(s) FROM step) + 1) % n AS at, CAST(floor(least(pow((CAST('0x' || substr(md5('1:' || i), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE, -1 / {fixtures.SHAPE}::DOUBLE), {fixtures.MOST}) * 1000000) AS HUGEINT) AS w FROM i0),
      i2 AS (SELECT *, w * (10000000 - n) AS pr, sum(w) OVER () AS ws FROM i1), i3 AS (SELECT *, pr // ws AS base, pr % ws AS rem FROM i2),
      i4 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, w DESC, i) AS r, 10000000 - n - sum(base) OVER () AS rest FROM i3)
      SELECT i, folders[CAST(CAST('0x' || substr(md5('1:folder:' || i), 1, 8) AS BIGINT) % len(folders) AS INTEGER) + 1] || '/' || name || '-' || lpad(CAST(i AS VARCHAR), 6, '0') || suffix AS path, kind, profile,
      CAST(base + 1 + CASE WHEN i4.r <= rest THEN 1 ELSE 0 END AS BIGINT) AS size FROM i4 ASOF JOIN p3 ON i4.at >= p3.first"""


_FIXTURE = _fixture_sql()


def _globs() -> tuple[str, str]:
    """The two selections in SQL: last match of the path, then of its parents, nearest first."""
    both = """SELECT zip_path FROM entries WHERE CASE
      WHEN NOT is_directory AND regexp_matches(zip_path, '^en/src2$') THEN FALSE
      WHEN regexp_matches(zip_path, '7[.]txt$') THEN FALSE WHEN zip_path LIKE 'en/_%' AND NOT is_directory THEN
        TRUE
      WHEN split_part(zip_path, '/', 2) = 'src3' AND NOT is_directory THEN TRUE
      WHEN zip_path LIKE 'de/src1/%' THEN TRUE ELSE FALSE END"""
    only = """SELECT zip_path FROM entries WHERE NOT (zip_path LIKE 'fr/_%') AND NOT regexp_matches(zip_path, '/src[0-4]/')"""
    return both, only


SQL = {
    "q_plan_sync": _plan_sql(_OPS),
    "q_plan_sync_local_profile": _plan_sql(_OPS, local=True),
    "q_plan_sync_ignore_catalog": _plan_sql(_OPS, catalog=False),
    "q_plan_sync_dry_delete": _plan_sql(f"{_OPS} UNION ALL {_DELETED}", dry=True),
    "q_sync_summary": _plan_sql(f"SELECT {_TOTALS}, {_COUNT('uploaded_new', 'uploaded_new')}, {_COUNT('uploaded_changed', 'uploaded_changed')}, {_COUNT('skipped_unchanged', 'skipped_unchanged')}, {_COUNT('conditional_conflict', 'conditional_conflicts')}, (SELECT count(*) FROM listing WHERE key NOT IN (SELECT key FROM entries)) AS deleted_extra, {_COUNT('error', 'errors')} FROM ops"),
    "q_dryrun_summary": _plan_sql(f"SELECT {_TOTALS}, {_COUNT('would_upload_new', 'would_upload_new')}, {_COUNT('would_upload_changed', 'would_upload_changed')}, {_COUNT('skipped_unchanged', 'skipped_unchanged')}, (SELECT count(*) FROM listing WHERE key NOT IN (SELECT key FROM entries)) AS would_delete_extra, {_COUNT('error', 'errors')} FROM ops", dry=True),
    "q_delete_extra": f"WITH {ENTRIES}, {LISTING} SELECT key, size, etag AS destination_etag FROM listing WHERE key NOT IN (SELECT key FROM entries)",
    "q_hash_phase": _plan_sql("SELECT key, CASE d WHEN 'skip_hash' THEN 'skip' ELSE 'upload' END AS action, md5, tag AS comparison_md5 FROM decided WHERE d IN ('skip_hash', 'upload_hash')"),
    "q_catalog_join": f"WITH {ENTRIES} SELECT zip_path, catalog_md5 FROM entries WHERE NOT is_directory",
    "q_plan_local": f"""WITH {ENTRIES} SELECT CASE WHEN doc_id % 3 = 0 AND NOT is_directory THEN 'would_upload_changed' WHEN doc_id % 29 = 1 AND NOT is_directory THEN 'error' WHEN is_directory THEN 'would_upload_new' ELSE 'would_upload_new' END AS status, zip_path,
      CASE WHEN doc_id % 29 = 1 THEN 'target exists and is of the other kind' END AS message FROM entries WHERE NOT (doc_id % 3 = 0 AND doc_id % 29 = 1)
      UNION ALL SELECT unnest(['would_upload_changed', 'error']), zip_path, unnest([NULL, 'target exists and is of the other kind']) FROM entries WHERE doc_id % 3 = 0 AND doc_id % 29 = 1""",
    "q_path_validation": f"""WITH {_RAW}, e AS (SELECT *, CASE WHEN raw_path = '' THEN 'empty path' WHEN raw_path LIKE '/%' THEN 'absolute path' WHEN contains(raw_path, '\\') THEN 'backslash path separators are not supported'
      WHEN rtrim(raw_path, '/') = '' THEN 'root directory entry' WHEN regexp_matches(rtrim(raw_path, '/'), '(^|/)(/|$)') THEN 'empty path component' WHEN regexp_matches(rtrim(raw_path, '/'), '(^|/)[.][.]?(/|$)') THEN 'relative path component'
      WHEN regexp_matches(raw_path, '^[A-Za-z]:(/|$)') THEN 'Windows drive prefix' END AS error FROM raw)
      SELECT page_id, raw_path, CASE WHEN error IS NULL THEN CASE WHEN raw_path LIKE '%/' THEN rtrim(raw_path, '/') || '/' ELSE raw_path END END AS zip_path, raw_path LIKE '%/' AS is_directory, error FROM e""",
    "q_local_component_safety": """SELECT page_id, 'site/' || m || '/f' AS path, m NOT IN ('ok.txt', 'com10') AS unsafe FROM (SELECT page_id, ['ok.txt', 'con', 'a:b', 'end.', 'Lpt1.log', 'x?y', 'com10', 'nul .txt'][page_id % 8 + 1] AS m FROM pages)""",
    "q_s3_uri_parse": """WITH u AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url ELSE regexp_replace(regexp_replace(url, '^https?://m[.]', 's3:///'), '^https?://(www[.])?', 's3://') END AS uri FROM pages),
      r AS (SELECT page_id, CASE WHEN uri LIKE 's3://%' THEN substr(uri, 6) END AS rest FROM u), s AS (SELECT page_id, rest, CASE WHEN contains(rest, '/') THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END AS bucket, CASE WHEN rest IS NULL THEN NULL WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/') + 1) ELSE '' END AS key FROM r)
      SELECT page_id, bucket, key, CASE WHEN rest IS NULL THEN 'missing s3:// scheme' WHEN bucket = '' THEN 'missing bucket' WHEN key = '' THEN 'missing object key' END AS error FROM s""",
    "q_normalize_etag": f"WITH {LISTING} SELECT key, {NORMAL.format('etag')} AS md5 FROM listing",
    "q_selection_include_exclude": f"WITH {ENTRIES} {_globs()[0]}",
    "q_selection_exclude_only": f"WITH {ENTRIES} {_globs()[1]}",
    "q_manifest_spans": f"""WITH {ENTRIES}, {_SPANS}, coarse AS (SELECT *, header_offset - header_offset % 4096 AS h FROM spans)
      SELECT archive, zip_path, h AS span_start, least(coalesce(min(h) OVER (PARTITION BY archive ORDER BY h RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), cd_start), cd_start) AS span_end FROM coarse""",
    "q_block_plan": f'WITH RECURSIVE {ENTRIES}, {LISTING}, {_classified(False, False, True)}, {_NEEDED} SELECT archive, block_id, start, "end" FROM blocks',
    "q_block_claims": f'WITH RECURSIVE {ENTRIES}, {LISTING}, {_classified(False, False, True)}, {_NEEDED} SELECT b.archive, b.block_id, count(n.archive) AS claims FROM blocks b LEFT JOIN needed n ON n.archive = b.archive AND b.start < n."end" AND n.start < b."end" + 1 GROUP BY b.archive, b.block_id',
    "q_point_to_block": f"""WITH RECURSIVE {ENTRIES}, {LISTING}, {_classified(False, False, True)}, {_NEEDED}, points AS (SELECT archive, zip_path, header_offset + 30 AS "offset" FROM spans)
      SELECT p.archive, p.zip_path, p."offset", CASE WHEN b."end" >= p."offset" THEN b.block_id END AS block_id FROM points p ASOF LEFT JOIN blocks b ON p.archive = b.archive AND p."offset" >= b.start""",
    "q_interval_union": f"WITH {_GETS}, {_UNION.format('gets')} SELECT event_type, fetched_bytes, unique_bytes, round(fetched_bytes / unique_bytes, 6) AS source_amplification FROM fetched JOIN uniq USING (event_type)",
    "q_source_diagnostics": f"""WITH {_GETS}, good AS (SELECT * FROM gets WHERE ok), {_UNION.format('good')}, n AS (SELECT event_type, count(*) AS source_get_attempts, count(*) FILTER (attempt > 1) AS source_get_retries, count(*) FILTER (NOT ok) AS source_get_errors, count(*) FILTER (ok) AS fetched_blocks FROM gets GROUP BY event_type)
      SELECT n.*, coalesce(fetched_bytes, 0) AS fetched_bytes, coalesce(unique_bytes, 0) AS unique_bytes, coalesce(round(fetched_bytes / unique_bytes, 6), 0) AS source_amplification FROM n LEFT JOIN fetched USING (event_type) LEFT JOIN uniq USING (event_type)""",
    "q_high_water": f"""WITH {_GETS}, g AS (SELECT * FROM gets WHERE "end" > start), edges AS (SELECT event_type, start AS t, 1 AS delta FROM g UNION ALL SELECT event_type, "end", -1 FROM g),
      o AS (SELECT event_type, sum(delta) OVER (PARTITION BY event_type ORDER BY t, delta ROWS UNBOUNDED PRECEDING) AS n FROM edges) SELECT event_type, CAST(max(n) AS BIGINT) AS high_water FROM o GROUP BY event_type""",
    "q_put_failures_by_code": f"WITH {_PUTS} SELECT error_code, count(*) AS failures, error_code = 'SlowDown' AS throttled FROM puts WHERE error_code IS NOT NULL GROUP BY error_code",
    "q_retry_backoff": f"WITH {_PUTS} SELECT event_id, attempt, CAST(CASE WHEN error_code = 'SlowDown' THEN least(30000, 1000 * pow(2, attempt - 1)) ELSE least(5000, 250 * pow(2, attempt - 1)) END AS BIGINT) AS delay_ms FROM puts",
    "q_adaptive_window": """WITH o AS (SELECT o_orderkey, CAST([128, 256, 512, 1024, 2048, 3008][o_orderkey % 6 + 1] AS BIGINT) AS m, CAST(floor(o_totalprice * 5000) AS BIGINT) AS z, o_custkey * 40 AS f FROM orders),
      w AS (SELECT *, CAST(greatest(4, least(round(sqrt(m / 128) * 4), 16)) AS BIGINT) AS workers, CAST(greatest(1, least(m // 256, 8)) AS BIGINT) AS gets FROM o),
      a AS (SELECT *, least(greatest(m * 1048576 - (67108864 + greatest(workers, 1) * 12582912 + f * 2048 + greatest(gets, 1) * 8388608), 0), z) AS room FROM w)
      SELECT o_orderkey, workers, gets, greatest(1, least(workers, 8)) AS puts, greatest(least(CASE WHEN room > 536870912 THEN room - 402653184 ELSE room END, 536870912), least(8388608, z)) AS window_bytes FROM a""",
    "q_multipart_parts": """WITH o AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) > 0), p AS (SELECT doc_id, size, unnest(generate_series(1, (size + 1023) // 1024)) AS n FROM o)
      SELECT doc_id, CAST(n AS BIGINT) AS part_number, CAST((n - 1) * 1024 AS BIGINT) AS part_start, CAST(least(1024, size - (n - 1) * 1024) AS BIGINT) AS part_bytes FROM p""",
    "q_pack_report": f"WITH {ENTRIES} SELECT count(*) FILTER (NOT is_directory) AS files, count(*) FILTER (is_directory) AS directories, count(*) AS entries, CAST(coalesce(sum(size) FILTER (NOT is_directory), 0) AS BIGINT) AS total_bytes FROM entries",
    "q_pack_progress": f"""WITH {ENTRIES}, r AS (SELECT archive, zip_path, size, CAST(count(*) FILTER (NOT is_directory) OVER w AS BIGINT) AS processed_files, CAST(sum(size) OVER w AS BIGINT) AS processed_bytes FROM entries WINDOW w AS (PARTITION BY archive ORDER BY zip_path ROWS UNBOUNDED PRECEDING))
      SELECT archive, zip_path, processed_files, processed_bytes, processed_bytes // 65536 > (processed_bytes - size) // 65536 AS emits FROM r""",
    "q_duplicates": f"WITH {ENTRIES} SELECT md5, count(*) AS copies FROM entries WHERE NOT is_directory GROUP BY md5 HAVING count(*) > 1",
    "q_path_collisions": """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages), e AS (SELECT DISTINCT CASE WHEN page_id % 50 = 0 THEN h WHEN page_id % 50 = 1 THEN upper(h || '/a/') ELSE h || '/p/' || page_id END AS zip_path FROM h),
      k AS (SELECT zip_path, zip_path LIKE '%/' AS dir, lower(rtrim(zip_path, '/')) AS target FROM e), a AS (SELECT zip_path, unnest(list_transform(range(1, len(string_split(target, '/'))), lambda i: array_to_string(string_split(target, '/')[1:i], '/'))) AS parent FROM k)
      SELECT zip_path, 'same target' AS reason FROM k WHERE target IN (SELECT target FROM k GROUP BY target HAVING count(*) > 1) UNION SELECT zip_path, 'below a file' FROM a WHERE parent IN (SELECT target FROM k WHERE NOT dir)""",
    "q_bench_aggregate": """SELECT CAST(l_linenumber * 128 AS BIGINT) AS memory_mb, l_returnflag AS fixture, l_linestatus AS run, 'catalog' AS catalog, count(*) AS samples, count(*) FILTER (l_quantity > 5) AS ok_samples, count(*) FILTER (NOT l_quantity > 5) AS failed_samples,
      min(l_extendedprice) FILTER (l_quantity > 5) AS duration_ms_min, median(l_extendedprice) FILTER (l_quantity > 5) AS duration_ms_median, max(l_extendedprice) FILTER (l_quantity > 5) AS duration_ms_max,
      min(l_quantity) FILTER (l_quantity > 5) AS max_memory_used_mb_min, median(l_quantity) FILTER (l_quantity > 5) AS max_memory_used_mb_median, max(l_quantity) FILTER (l_quantity > 5) AS max_memory_used_mb_max FROM lineitem GROUP BY 1, 2, 3, 4""",
    "q_fixture_classes": f"WITH {ENTRIES} SELECT CASE WHEN doc_id % 5 < 2 THEN 'compressible' WHEN doc_id % 5 < 4 THEN 'incompressible' ELSE 'mixed' END AS kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM entries WHERE NOT is_directory GROUP BY 1",
    "q_mutate_5pct": f"WITH {ENTRIES} SELECT zip_path FROM (SELECT zip_path, row_number() OVER (ORDER BY md5('7:' || zip_path), zip_path) AS rn, count(*) OVER () AS n FROM entries WHERE NOT is_directory) WHERE rn <= ceil(n * 5 / 100)",
    "q_economics": """WITH c AS (SELECT source AS corpus, CAST(count(*) * 100000 AS DOUBLE) AS n, pow(2.0, min(doc_id) % 5 * 2 + 3) AS k FROM documents GROUP BY source), g AS (SELECT *, n * k / 1048576.0 AS gib, n * greatest(k, 128) / 1048576.0 AS billed FROM c)
      SELECT corpus, 'zip_standard' AS storage_class, round(gib / 4 * 0.023 + n * 0.1 / 1000 * 0.0004, 3) AS usd_month FROM g UNION ALL SELECT corpus, 'standard', round(gib * 0.023 + n * 0.1 / 1000 * 0.0004, 3) FROM g
      UNION ALL SELECT corpus, 'standard_ia', round(billed * 0.0125 + n * 0.1 / 1000 * 0.001 + gib * 0.1 * 0.01, 3) FROM g UNION ALL SELECT corpus, 'intelligent_tiering', round(gib * 0.023 + n * 0.1 / 1000 * 0.0004 + CASE WHEN k >= 128 THEN n ELSE 0 END / 1000 * 0.0025, 3) FROM g
      UNION ALL SELECT corpus, 'glacier_instant', round(billed * 0.004 + n * 0.1 / 1000 * 0.01 + gib * 0.1 * 0.03, 3) FROM g""",
    "q_generated_fixture": _FIXTURE,
    "q_zip_roundtrip": "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS md5 FROM pages",
    "q_parse_size": """WITH p AS (SELECT p_partkey, p_size, p_partkey % 7 AS u, CAST(p_size AS VARCHAR) || '.5' || ['', 'KB', 'KiB', 'MiB', 'k', 'GB', 'x'][p_partkey % 7 + 1] AS size_text FROM part)
      SELECT p_partkey, size_text, CAST(floor((p_size + 0.5) * CASE u WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 WHEN 4 THEN 1024 WHEN 5 THEN 1000000000 END) AS BIGINT) AS bytes FROM p""",
    "q_report_lines": """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'r' || event_id END AS request_id, CASE WHEN event_id % 4 <> 0 THEN event_id + 0.25::DOUBLE END AS duration_ms, CASE WHEN event_id % 4 <> 0 THEN event_id + 1 END AS billed_duration_ms,
      CASE WHEN event_id % 4 <> 0 THEN 256::BIGINT END AS memory_size_mb, CASE WHEN event_id % 4 <> 0 THEN user_id END AS max_memory_used_mb FROM events""",
}


SQL |= live_queries.SQL


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("q_")} | live_queries.queries()
