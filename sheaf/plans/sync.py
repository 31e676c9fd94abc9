"""Incremental extraction as a plan: manifest, catalog and listing become operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.etags import EMPTY_MD5, comparable_md5, normalize_etag
from sheaf.functions.paths import join_key, normalized_path, path_error
from sheaf.functions.tuning import SINGLE_PUT_LIMIT
from sheaf.operators.diagnostics import dry_status
from sheaf.operators.selection import selected
from sheaf.plans.options import SyncOptions

OPERATIONS = ("status", "key", "zip_path", "size", "md5", "destination_etag", "message")


def catalog_entries(catalog: DataFrame, catalog_path: str) -> DataFrame:
    """(zip_path, catalog_md5) of parsed catalogs (version, entries): version 1 only, safe file
    paths, MD5 digests, the last of duplicates.  With a column ``archive`` each archive has its own."""
    keys = ["archive"] if "archive" in catalog.columns else []
    each = catalog.where("version = 1").select(*keys, F.posexplode("entries").alias("pos", "e")).select(*keys, "pos", F.col("e.path").alias("raw"), normalize_etag(F.col("e.md5")).alias("md5"))
    path = normalized_path(F.col("raw"))
    kept = each.withColumn("zip_path", path).where(F.col("md5").isNotNull() & F.col("zip_path").isNotNull() & ~F.col("zip_path").endswith("/") & (F.col("zip_path") != catalog_path))
    return kept.groupBy(*keys, "zip_path").agg(F.max_by("md5", "pos").alias("catalog_md5"))


def join_catalog(manifest: DataFrame, catalog: DataFrame, keys: list[str] = ["zip_path"]) -> DataFrame:
    """Add ``catalog_md5`` to the entries.  Spark picks the join by the catalog's size."""
    return manifest.drop("catalog_md5").join(catalog.select(*keys, "catalog_md5"), keys, "left")


def entry_error(limit: int | None = SINGLE_PUT_LIMIT) -> Column:
    """Why an entry cannot be extracted; null where it can."""
    directory = F.col("is_directory")
    error = F.when(directory & ((F.col("size") != 0) | (F.col("compressed_size") != 0) | (F.col("crc32") != 0)), "directory entry has content")
    error = error.when(~directory & ~F.col("compression").isin("stored", "deflate", "zstd"), "unsupported compression method")
    return error.when(~directory & (F.col("size") > limit), "entry too large") if limit is not None else error


def prepared(raw: DataFrame, opts: SyncOptions) -> DataFrame:
    """Manifest rows from raw records: unsafe paths are fatal, the catalog goes, then the selection,
    then the checks of entries (so an entry that is not selected is never checked)."""
    bad = F.when(path_error(F.col("raw_path")).isNotNull(), F.raise_error(F.concat(F.lit("unsafe archive path: "), F.col("raw_path"))))
    df = raw.withColumn("zip_path", F.coalesce(bad.cast("string"), normalized_path(F.col("raw_path"))))
    df = df.withColumn("is_directory", F.col("zip_path").endswith("/"))
    df = df.where(F.col("zip_path") != opts.catalog_path).where(selected(F.col("zip_path"), opts.selection))
    df = df.withColumn("_e", entry_error())
    df = df.withColumn("zip_path", F.when(F.col("_e").isNotNull(), F.raise_error(F.concat_ws(": ", "zip_path", "_e")).cast("string")).otherwise(F.col("zip_path"))).drop("_e")
    return df.withColumn("key", join_key(F.lit(opts.prefix), F.col("zip_path")))


def classify(manifest: DataFrame, listing: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """The plan: every entry with action, condition, md5 and message.

    ``manifest`` has key, zip_path, is_directory, size and catalog_md5; ``listing`` has key, etag
    and size.  Actions: ``skip``, ``upload``, ``hash`` and ``error``.  The first rule that fits
    decides; see ``hash_phase`` for what becomes of hashes.
    """
    there = listing.select(F.col("key").alias("_k"), "etag", F.col("size").alias("listed_size"), F.lit(True).alias("_listed"))
    df = manifest.join(there, F.col("key") == F.col("_k"), "left").withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_k", "_listed")
    df = df.withColumn("catalog_md5", F.col("catalog_md5") if opts.use_catalog else F.lit(None).cast("string"))
    local = opts.profile == "local_zip"
    tag, listed, directory = normalize_etag(F.col("etag")), F.col("listed"), F.col("is_directory")
    same_size = F.coalesce(F.col("listed_size") == F.col("size"), F.lit(True)) if local else F.lit(True)
    in_catalog = F.coalesce((F.col("catalog_md5") == tag) & same_size, F.lit(False))
    comparable = comparable_md5(F.col("size"), F.col("listed_size"), F.col("etag"))
    rules = [
        (directory & ~listed, "upload", "if_none_match", None, None),
        (directory & (F.col("listed_size") == 0), "skip", None, F.lit(EMPTY_MD5), None),
        (directory & F.col("listed_size").isNotNull(), "error", None, None, F.concat(F.lit("directory marker exists with nonzero size "), F.col("listed_size").cast("string"))),
        (directory, "error", None, None, F.lit("directory marker is listed without a size")),
        (in_catalog, "skip", None, F.col("catalog_md5"), None),
        (~listed, "upload", "if_none_match", F.col("catalog_md5"), None),
    ]
    no_tag = F.col("etag").isNull()
    if not local or opts.dry_run:
        rules.append((no_tag, "error", None, F.col("catalog_md5") if local else None, F.lit("destination object was listed without an ETag")))
    else:
        rules.append((no_tag, "upload", "if_none_match", F.col("catalog_md5"), None))
    if not local:
        rules.append((F.col("catalog_md5").isNotNull(), "upload", "if_match", F.col("catalog_md5"), None))
    rules.append((comparable.isNotNull(), "hash", "if_match", F.col("catalog_md5"), None))
    rules.append((F.lit(True), "upload", "if_match", F.col("catalog_md5"), None))

    def pick(i: int, kind: str = "string") -> Column:
        out = None
        for r in rules:
            value = (F.lit(r[i]) if not isinstance(r[i], Column) else r[i]).cast(kind)
            out = F.when(r[0], value) if out is None else out.when(r[0], value)
        return out

    return df.withColumns({"action": pick(1), "condition": pick(2), "md5_out": pick(3), "message": pick(4), "comparison_md5": comparable})


def hash_phase(plan: DataFrame, digests: DataFrame) -> DataFrame:
    """Resolve ``hash`` rows by content digests (key, md5): equal ones are skipped, others uploaded."""
    found = digests.select(F.col("key").alias("_k"), F.col("md5").alias("_d"))
    df = plan.join(found, (F.col("key") == F.col("_k")) & (F.col("action") == "hash"), "left").drop("_k")
    is_hash = F.col("action") == "hash"
    action = F.when(is_hash & F.col("_d").isNull(), "error").when(is_hash & (F.col("_d") == F.col("comparison_md5")), "skip").when(is_hash, "upload").otherwise(F.col("action"))
    message = F.when(is_hash & F.col("_d").isNull(), "entry content could not be read").otherwise(F.col("message"))
    return df.withColumns({"md5_out": F.when(is_hash, F.col("_d")).otherwise(F.col("md5_out")), "message": message, "action": action}).drop("_d")


def operations(plan: DataFrame) -> DataFrame:
    """Report rows of a resolved plan, as they are if every upload succeeds."""
    status = (
        F.when(F.col("action") == "skip", "skipped_unchanged").when(F.col("action") == "error", "error")
        .when(F.col("condition") == "if_match", "uploaded_changed").otherwise("uploaded_new")
    )
    return plan.select(status.alias("status"), "key", "zip_path", F.col("size"), F.col("md5_out").alias("md5"), F.col("etag").alias("destination_etag"), "message")


def delete_extra(listing: DataFrame, manifest: DataFrame, dry: bool = False) -> DataFrame:
    """Listed objects that no entry has; a dry run also tells their size and tag."""
    extra = listing.join(manifest.select("key"), "key", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return extra.select(
        F.lit("would_delete_extra" if dry else "deleted_extra").alias("status"), "key", none("string").alias("zip_path"), (F.col("size") if dry else none("long")).alias("size"),
        none("string").alias("md5"), (F.col("etag") if dry else none("string")).alias("destination_etag"), none("string").alias("message"),
    )


def plan_sync(manifest: DataFrame, listing: DataFrame, digests: DataFrame | None = None, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """All operation rows of a synchronisation, without doing any of it."""
    plan = classify(manifest, listing, opts)
    if digests is not None:
        plan = hash_phase(plan, digests)
    out = operations(plan)
    if opts.dry_run:
        out = out.withColumn("status", dry_status(F.col("status")))
    return out.unionByName(delete_extra(listing, manifest, opts.dry_run)) if opts.delete_extra else out


def plan_local(manifest: DataFrame, existing: DataFrame, dry: bool = True) -> DataFrame:
    """Extraction to local files: files there are rewritten, never compared; directories are kept.

    ``existing`` has zip_path and is_directory of what the target holds.
    """
    there = existing.select(F.col("zip_path").alias("_p"), F.col("is_directory").alias("_d"))
    df = manifest.join(there, F.regexp_replace("zip_path", "/$", "") == F.regexp_replace("_p", "/$", ""), "left")
    clash = F.col("_p").isNotNull() & (F.col("_d") != F.col("is_directory"))
    status = F.when(clash, "error").when(F.col("_p").isNull(), "uploaded_new").when(F.col("is_directory"), "skipped_unchanged").otherwise("uploaded_changed")
    message = F.when(clash, "target exists and is of the other kind")
    return df.select((dry_status(status) if dry else status).alias("status"), "key", "zip_path", "size", F.col("catalog_md5").alias("md5"), F.lit(None).cast("string").alias("destination_etag"), message.alias("message"))

