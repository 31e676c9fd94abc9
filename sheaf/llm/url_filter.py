"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions only: the features are built-in expressions, the trees are Spark ML's
histogram trees (JVM), and the scores are a JVM transform.

Nulls and odd input: a null url, or one without ``://``, has empty host and path, fits no rule,
and is scored on zero features.  Repeated rows are judged alike.  Without labelled rows of both
kinds the trees cannot be fitted and every unruled url gets the only known label (allow if none).
Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import ascii_lower, at_most, stored

FEATURES = (
    "n_url", "n_host", "n_path", "depth", "labels", "digit_ratio", "host_digits", "entropy",
    "params", "hyphens", "is_https", "has_fragment", "suffix_rate", "suffix_seen", "ext_rate", "ext_seen",
)


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://``; the path ends before ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    ``rules`` is a configuration list of (verdict, "host/path").  A rule fits its host and all
    subdomains when the url's path starts with the rule's path.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = verdict = None
    for kind, text in ordered:
        rhost, slash, rpath = text.partition("/")
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(slash + rpath)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Add host, path and the lexical features of ``url``."""
    host, path = parse_url(F.col(url))
    text = F.coalesce(F.col(url), F.lit(""))
    df = df.withColumns({"host": host, "path": path, "_t": text})
    n = F.length("_t").cast("double")
    share = lambda c: (n - F.length(F.replace(F.col("_t"), c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split("_t", "")), lambda c: c != "")
    query = F.regexp_extract("_t", r"\?([^#]*)", 1)
    return df.withColumns({
        "n_url": n, "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"), "labels": _count(F.col("host"), r"\.") + 1,
        "digit_ratio": F.when(n > 0, _count(F.col("_t"), "[0-9]") / n).otherwise(0.0), "host_digits": _count(F.col("host"), "[0-9]"),
        "entropy": F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))),
        "params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "hyphens": _count(F.col("host"), "-"),
        "is_https": F.col("_t").startswith("https:").cast("double"), "has_fragment": F.col("_t").contains("#").cast("double"),
        "suffix": F.element_at(F.split("host", r"\."), -1), "ext": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,6})$", 1),
    }).drop("_t")


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """How many labelled urls have a key, and how many of them are blocked."""
    return labelled.groupBy(key).agg(F.sum("label").alias(f"{key}_sum"), F.count("*").cast("double").alias(f"{key}_n"))


def judge_urls(
    urls: DataFrame, rules, *, key: str = "page_id", url: str = "url", labelled: DataFrame | None = None,
    train_rows: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7,
) -> DataFrame:
    """One row per url: key, host, path, rule, verdict, score (the trees' chance of block).

    ``labelled`` (url, label 0/1; 1 is block) trains the trees; by default the urls that a rule
    decides are the labelled ones.  At most ``train_rows`` of them are fitted, picked by a
    hash of the url; the suffix statistics count all of them, but for a fitted row its own label.
    """
    base = lexical(urls.select(F.col(key).alias("_k"), F.col(url).alias("_u")), "_u")
    rule, kind = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "kind": kind})
    if labelled is None:
        known = base.where("kind is not null").withColumn("label", (F.col("kind") == "block").cast("double"))
    else:
        known = lexical(labelled.select(F.col("url").alias("_u"), F.col("label").cast("double").alias("label")), "_u").where("label is not null")
    counts = known.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = counts["n"], counts["pos"] or 0.0
    prior = pos / n if n else 0.0
    if 0 < pos < n:
        suffixes, exts = (stored(_rates(known, k), f"url-{k}") for k in ("suffix", "ext"))

        def with_rates(df: DataFrame, own: Column) -> DataFrame:
            """Smoothed shares of blocked urls and their support; a row's own label does not count."""
            df = df.join(suffixes, "suffix", "left").join(exts, "ext", "left")
            for k in ("suffix", "ext"):
                n = F.coalesce(f"{k}_n", F.lit(0.0)) - F.when(own.isNotNull(), 1.0).otherwise(0.0)
                total = F.coalesce(f"{k}_sum", F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
                df = df.withColumns({f"{k}_rate": (total + 4 * prior) / (n + 4), f"{k}_seen": F.log1p(n)})
            return df

        chosen = at_most(known, train_rows, n, "_u", seed=seed)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        fit_on = stored(with_rates(chosen, F.col("label")).select("label", *FEATURES), "url-train")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=seed).fit(vectors.transform(fit_on))
        scored = model.transform(vectors.transform(with_rates(base, F.lit(None).cast("double"))))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    else:
        scored = base.withColumn("score", F.lit(prior))
    judged = F.coalesce("kind", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("_k").alias(key), "host", "path", "rule", judged.alias("verdict"), F.round("score", 9).alias("score"))


#: The rules of the url query.
QUERY_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
