"""Deterministic fixtures: generated trees, mutations and their manifests."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of content with their shares; their profiles with suffix, weight and name of
# the files, and the folders that such files lie in.
KINDS = (("compressible", 0.4), ("incompressible", 0.4), ("mixed", 0.2))
PROFILES = {
    "compressible": (
        ("markdown", ".md", 16, "guide", ("docs", "docs/reference", "docs/how-to")),
        ("typescript", ".ts", 14, "component", ("packages/web/src", "app/src/routes")),
        ("json", ".json", 12, "metadata", ("config", "packages/web/fixtures", "data/schemas")),
        ("javascript", ".js", 10, "bundle", ("site/assets", "packages/cli/lib", "scripts")),
        ("rust", ".rs", 8, "module", ("crates/core/src", "crates/lambda/src")),
        ("css", ".css", 7, "styles", ("site/styles", "packages/web/src/styles")),
        ("html", ".html", 6, "page", ("site/pages", "public")),
        ("python", ".py", 6, "task", ("tools", "scripts", "tests")),
        ("yaml", ".yaml", 5, "workflow", (".github/workflows", "config/deploy")),
        ("log", ".log", 5, "deploy", ("logs", "var/reports")),
        ("toml", ".toml", 3, "manifest", ("config", "crates/core")),
    ),
    "incompressible": (
        ("png", ".png", 26, "image", ("public/assets/images",)),
        ("jpeg", ".jpg", 18, "photo", ("public/assets/images",)),
        ("font", ".woff2", 16, "font", ("public/assets/fonts",)),
        ("brotli", ".br", 14, "precompressed", ("public/assets/compressed",)),
        ("zip", ".zip", 12, "archive", ("vendor/archives",)),
        ("binary", ".bin", 14, "blob", ("data/binary",)),
    ),
    "mixed": (
        ("source-map", ".map", 35, "chunk", ("site/assets", "packages/web/dist")),
        ("bundled-js", ".js", 25, "app", ("site/assets", "packages/web/dist")),
        ("wasm", ".wasm", 18, "module", ("public/assets/wasm",)),
        ("sqlite", ".db", 12, "cache", ("data/cache",)),
        ("packed", ".dat", 10, "asset", ("public/assets/packed",)),
    ),
}
#: The shape of the sizes' distribution, the largest weight, and the block of mixed content.
SHAPE, MOST, MIXED_BLOCK = 1.35, 100.0, 8192


def shares(total: int, weights: list[float]) -> list[int]:
    """Whole numbers that sum to ``total`` by weight: floors, and one more for the largest fractions
    (of equal ones for the heavier, then the earlier)."""
    raw = [total * w / (sum(weights) or 1) for w in weights]
    out = [int(x) for x in raw]
    ranked = sorted(range(len(weights)), key=lambda i: (-(raw[i] - out[i]), -weights[i], i))
    for i in ranked[: total - sum(out)]:
        out[i] += 1
    return out


def largest_remainder(weighted: DataFrame, total: int, keys: list[str], weight: str = "w", least: int = 0) -> DataFrame:
    """Split ``total`` by a whole-number weight into whole numbers that sum to it: add ``share``.

    Everyone gets ``least``, then the floor of its part of the rest, and the largest remainders one
    more (of equal ones the heavier, then the first by ``keys``).  The remainder that is the last to
    get one is found from a histogram, and only its bin is ordered.
    """
    sums = weighted.agg(F.sum(F.col(weight).cast("decimal(38,0)")).alias("w"), F.count("*").alias("n")).first()
    if not sums["n"]:
        return weighted.withColumn("share", F.lit(0).cast("long"))
    whole, rest = int(sums["w"]), total - least * sums["n"]
    product = F.col(weight).cast("decimal(19,0)") * F.lit(rest).cast("decimal(19,0)")
    big = F.lit(whole).cast("decimal(38,0)")
    split = weighted.withColumn("_rem", (product % big).cast("decimal(38,0)"))
    split = split.withColumn("_base", ((product - F.col("_rem")) / big).cast("decimal(38,0)").cast("long"))
    split = split.withColumn("_bin", F.floor(F.col("_rem").cast("double") / float(whole) * 65536).cast("int"))
    hist = {r["_bin"]: (r["n"], int(r["b"])) for r in split.groupBy("_bin").agg(F.count("*").alias("n"), F.sum("_base").alias("b")).collect()}
    left, cut = rest - sum(b for _, b in hist.values()), 1 << 20
    for i in sorted(hist, reverse=True):
        if left <= 0:
            break
        cut = i
        if hist[i][0] >= left:
            break
        left -= hist[i][0]
    last = split.where(F.col("_bin") == cut).orderBy(F.desc("_rem"), F.desc(weight), *keys).limit(max(0, left)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(1).alias("_one"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    out = split.join(last, on, "left")
    more = F.when(F.col("_bin") > cut, 1).otherwise(F.coalesce("_one", F.lit(0)))
    return out.withColumn("share", (F.col("_base") + least + more).cast("long")).drop("_rem", "_base", "_bin", "_one", *[f"_{k}" for k in keys])


def digest_number(*parts) -> Column:
    """The first 32 bits of the MD5 of values joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def stride(files: int, seed: int) -> int:
    """A step that is coprime to the number of files, so that i * step takes each place once."""
    step = (seed * 2_654_435_761 + 40_503) % max(1, files)
    while math.gcd(step, files) != 1:
        step += 1
    return step


def plan_places(files: int) -> list[tuple[int, str, str, str, str, tuple[str, ...]]]:
    """(first place, kind, profile, suffix, name, folders): how places are shared among profiles."""
    out, at = [], 0
    for (kind, _), n in zip(KINDS, shares(files, [s for _, s in KINDS])):
        group = PROFILES[kind]
        for (profile, suffix, _, name, folders), m in zip(group, shares(n, [p[2] for p in group])):
            if m:
                out.append((at, kind, profile, suffix, name, folders))
            at += m
    return out


def generate(spark: SparkSession, files: int, total_size: int, seed: int = 1) -> DataFrame:
    """A generated tree: i, path, kind, profile and size; every file has a byte at least.

    Kinds and profiles have exactly their shares: a file's place is a permutation of its number, and
    places are shared out.  Sizes follow a capped Pareto distribution, by largest remainder.
    """
    at = (F.col("i") * stride(files, seed) + seed) % files
    groups = plan_places(files)
    place = F.lit(None)
    for first, kind, profile, suffix, name, folders in groups:
        row = F.struct(F.lit(kind).alias("kind"), F.lit(profile).alias("profile"), F.lit(suffix).alias("suffix"), F.lit(name).alias("name"), F.array(*map(F.lit, folders)).alias("folders"))
        place = F.when(F.col("at") >= first, row).otherwise(place)
    chance = (digest_number(F.lit(seed), F.col("i")) + 1) / F.lit(float(1 << 32))
    weight = F.floor(F.least(F.pow(chance, F.lit(-1 / SHAPE)), F.lit(MOST)) * 1_000_000).cast("long")
    base = spark.range(files).withColumnRenamed("id", "i").withColumn("at", at).withColumns({"p": place, "w": weight})
    sized = largest_remainder(base, total_size, ["i"], least=1)
    folder = F.element_at("p.folders", (digest_number(F.lit(seed), F.lit("folder"), F.col("i")) % F.size("p.folders") + 1).cast("int"))
    path = F.concat(folder, F.lit("/"), F.col("p.name"), F.lit("-"), F.lpad(F.col("i").cast("string"), 6, "0"), F.col("p.suffix"))
    return sized.select("i", path.alias("path"), "p.kind", "p.profile", F.col("share").alias("size"))


def file_bytes(seed: int, index: int, kind: str, profile: str, size: int, mutation: bool = False) -> bytes:
    """Content of a generated file: records of words, random bytes, or three blocks of the one to one
    of the other."""
    rng = np.random.default_rng([seed, index, int(mutation)])
    if kind == "incompressible":
        return rng.bytes(size)
    words = np.array([f"{profile}-{k:x}" for k in range(96)])
    lines = max(1, size // 24 + 1)
    text = "\n".join(f"{n} {a} {b}" for n, (a, b) in enumerate(words[rng.integers(0, 96, (lines, 2))]))
    text = (text.encode() * (size // max(1, len(text)) + 1))[:size]
    if kind == "compressible":
        return text
    out = bytearray(text)
    for at in range(3 * MIXED_BLOCK, size, 4 * MIXED_BLOCK):
        end = min(size, at + MIXED_BLOCK)
        out[at:end] = rng.bytes(end - at)
    return bytes(out)


def write_tree(rows: DataFrame, root: str, seed: int = 1) -> DataFrame:
    """Write the files of a generated tree below a folder that all tasks share: path, size, sha256.

    Rows have i, path, kind, profile and size, and ``changed`` where a file is to get new content
    of the same size.
    """
    from sheaf.sources.stores import LocalStore

    fields = pa.schema([("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string())])
    changed = F.col("changed") if "changed" in rows.columns else F.lit(False)

    def run(batches):
        store = LocalStore(root)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = file_bytes(seed, r["i"], r["kind"], r["profile"], r["size"], r["changed"])
                store.put(r["path"], data)
                out.append({"path": r["path"], "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.select("i", "path", "kind", "profile", "size", changed.alias("changed")).mapInArrow(run, "path string, size long, sha256 string")


def mutation_count(n: Column, ratio: Column) -> Column:
    return F.least(F.ceil(n * ratio), n).cast("long")


def mutate(entries: DataFrame, ratio: float, seed: int, key: str = "path") -> DataFrame:
    """Mark a seeded sample without replacement as changed: exactly ceil(n * ratio) entries."""
    n = entries.count()
    take = min(-(-int(round(n * ratio * 1_000_000)) // 1_000_000), n)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    chosen = entries.select(F.col(key).alias("_k"), order.alias("_o")).orderBy("_o", "_k").limit(take).select("_k", F.lit(True).alias("_c"))
    return entries.join(chosen, F.col(key) == F.col("_k"), "left").withColumn("changed", F.coalesce("_c", F.lit(False))).drop("_k", "_c")


def class_stats(entries: DataFrame, by: str) -> DataFrame:
    return entries.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def mutation_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if("changed").alias("changed_files"), F.count_if(~F.col("changed")).alias("unchanged_files"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("size"))), F.lit(0)).alias("changed_bytes"))


def bench_cases(spark: SparkSession, fixtures: list[str], runs: list[str], memories: list[int], samples: int) -> DataFrame:
    """All benchmark cases: fixtures x runs x memories x samples (small configuration lists)."""
    one = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    return one("fixture", fixtures).crossJoin(one("run", runs)).crossJoin(one("memory_mb", memories)).crossJoin(one("sample", list(range(samples))))


MANIFEST = """version int, seed long, files long, total_size long,
  classes map<string, struct<files: bigint, bytes: bigint>>, profiles map<string, struct<files: bigint, bytes: bigint>>,
  entries array<struct<path: string, kind: string, profile: string, size: bigint, sha256: string, changed: boolean, original_sha256: string>>"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A fixture's JSON manifest (plain or mutated) as one row."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """Its entries in order: pos, path, kind, profile, size, sha256, changed and original_sha256."""
    return manifest.select(F.posexplode("entries").alias("pos", "e")).select("pos", "e.*")


def manifest_row(entries: DataFrame, seed: int, version: int = 1) -> DataFrame:
    """One row to write as JSON: totals, statistics by class and profile, and the entries by path."""
    stats = lambda by: class_stats(entries, by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, F.struct("files", "bytes")))))).toDF("classes" if by == "kind" else "profiles")
    kept = [c for c in ("path", "kind", "profile", "size", "sha256", "changed", "original_sha256") if c in entries.columns]
    one = entries.agg(F.count("*").alias("files"), F.sum("size").alias("total_size"), F.array_sort(F.collect_list(F.struct(*kept))).alias("entries"))
    return one.crossJoin(stats("kind")).crossJoin(stats("profile")).select(F.lit(version).alias("version"), F.lit(seed).alias("seed"), "files", "total_size", "classes", "profiles", "entries")


def compare_by_position(base: DataFrame, mutated: DataFrame) -> DataFrame:
    """Entries of two manifests side by side, by position: which changed."""
    b = base.select("pos", F.col("path").alias("base_path"), F.col("sha256").alias("base_sha256"))
    return mutated.join(b, "pos", "full_outer").withColumn("differs", ~F.col("sha256").eqNullSafe(F.col("base_sha256")))
