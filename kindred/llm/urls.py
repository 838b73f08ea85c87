"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule such as ``net/es/`` holds for its host and all subdomains if the path begins with the
rule's; the longest rule wins (of equal length the first listed).  URLs that a rule covers are
the labelled examples.  Trees are boosted on length, depth, digit ratio, entropy, parameter
counts and suffix statistics (how often the labelled URLs of a host suffix are blocked, smoothed
towards the mean) and judge every URL that no rule covers.

Suffix statistics cover all labelled URLs and are kept per suffix; a suffix without labelled URLs
has the mean.  Trees are fitted on ``TRAIN_ROWS`` labelled URLs at
most, chosen by hash, with blocked and allowed ones weighing the same in all.  A null URL, or one without ``://``, has an empty host and path and is
judged by the trees like others.  Without labelled URLs of both kinds the rest is allowed.
Repeated rows repeat their result, no rows give no rows, further columns are left out.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_rows, stored

# The rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
TRAIN_ROWS = 20_000
#: Steps of the hash by which training rows are chosen.
SAMPLE_STEPS = 1 << 52
TREES, LEVELS, SEED = 12, 4, 11
PRIOR_WEIGHT = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length",
    "host_length",
    "path_length",
    "labels",
    "depth",
    "digit_ratio",
    "entropy",
    "parameters",
    "assignments",
    "hyphens",
    "suffix_rate",
    "top_rate",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return (
        F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER),
        F.regexp_extract(whole, pattern, 2),
    )


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add the winning rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        on_host = (F.col("host") == name) | F.col("host").endswith("." + name)
        holds = on_host & F.col("path").startswith(slash + rest)
        rule = F.when(holds, F.lit(text)).otherwise(rule)
        verdict = F.when(holds, F.lit(kind)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruled", verdict)


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features of ``url`` and its host's suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    signs = F.split(url, "")
    counts = F.transform(F.array_distinct(signs), lambda c: n - F.char_length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(
        F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / n * F.log2(c / n)
    )
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.char_length(F.regexp_replace(url, "[^0-9]", ""))

    def suffix(parts: int) -> Column:
        return F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(parts)), F.lit(parts)), ".")

    return urls.select(
        "*",
        F.char_length(url).cast("double").alias("length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        F.size(labels).cast("double").alias("labels"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"),
        (digits / n).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&"))).cast("double").alias("parameters"),
        (F.char_length(query) - F.char_length(F.replace(query, F.lit("="), F.lit("")))).cast("double").alias("assignments"),
        (F.char_length("host") - F.char_length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        suffix(2).alias("suffix"),
        suffix(1).alias("top"),
    )


def block_rates(labelled: DataFrame, key: str, mean: float) -> DataFrame:
    """Smoothed share of blocked URLs per suffix."""
    rate = (F.sum("label") + PRIOR_WEIGHT * mean) / (F.count("*") + PRIOR_WEIGHT)
    return labelled.groupBy(key).agg(rate.alias(f"{key}_rate"))


def judge(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and the trees' blocking probability to rows with a ``url``."""
    host, path = host_and_path(F.col("url"))
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "p_block")]
    rows = packed_rows(urls.select(*own), "url")
    seen = stored(lexical(ruled(rows.withColumn("host", host).withColumn("path", path), rules)))
    labelled = seen.filter("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    out = ["__row.*", "host", "path", "rule"]
    if not 0 < blocked < n:
        return seen.select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("p_block"))
    mean = blocked / n
    rated = seen
    for key in ("suffix", "top"):
        # The rates are stored, so the join is a broadcast where they are small and skew-split where not.
        rates = stored(block_rates(labelled, key, mean))
        rated = rated.join(rates, key, "left").fillna(mean, [f"{key}_rate"])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__v").transform(rated)
    # Each label has its own share, so a rare one is not lost; at least one step of 2^52 is taken.
    counts = {1.0: blocked, 0.0: n - blocked}
    share = {label: min(1.0, 0.45 * TRAIN_ROWS / m) for label, m in counts.items()}
    label = (F.col("ruled") == "block").cast("double")

    def by_label(value) -> Column:
        return F.when(label == 1, F.lit(value(1.0))).otherwise(F.lit(value(0.0)))

    steps = by_label(lambda x: max(1, int(share[x] * SAMPLE_STEPS)))
    sample = (
        vectors.filter("ruled IS NOT NULL")
        .filter(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(SAMPLE_STEPS)) < steps)
        .select("__v", label.alias("__label"), by_label(lambda x: 0.5 * n / (counts[x] * share[x])).alias("__weight"))
        .orderBy(F.xxhash64("__label", "__v"))
        .limit(TRAIN_ROWS)
    )
    trees = GBTClassifier(
        featuresCol="__v", labelCol="__label", weightCol="__weight", maxIter=TREES, maxDepth=LEVELS, seed=SEED, cacheNodeIds=False
    )
    if sample.select("__label").distinct().count() < 2:
        return seen.select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("p_block"))
    model = trees.fit(sample.repartition(4))
    model.setPredictionCol("__p").setProbabilityCol("__probability").setRawPredictionCol("__raw")
    p = F.get(vector_to_array("__probability"), F.lit(1))
    judged = model.transform(vectors).withColumn("p_block", p)
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), "p_block")


def url_report(pages: DataFrame) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")
