"""URL filters: host and path rules first, boosted trees on lexical features else.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end. A rule fits its host and all
subdomains if the path starts with the rule's; the longest rule wins.

Features of a URL: length, host and path length, host labels, path depth, digit
ratio, hyphens, character entropy, number of parameters, length of the query,
and the suffix statistics of the host's last one, two and three labels: the
share of unwanted pages among labelled ones with that suffix, drawn to the
overall share by ``prior`` pages. A training URL gets the statistics of the other
folds, so that they do not tell its own label.
Spark's gradient-boosted trees are trained on all labelled URLs (label 1: low
quality or toxic); the rest is allowed unless its probability reaches
``threshold``. All features are DataFrame functions; only URLs are moved, and
suffix statistics are joined, not gathered.

Defined results: null or no ``://``: host and path are empty, features are of
the empty text; without labels of both kinds everything not ruled on is allowed;
repeated rows are judged alike; labels repeated for an id count each; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import store

_LEXICAL = [
    "url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "query_length",
]
_SUFFIXES = (1, 2, 3)
_FOLDS = 5
FEATURES = [*_LEXICAL, *(f"suffix_{k}" for k in _SUFFIXES)]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.instr(F.col(url), F.lit("://"))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (as ``host/path``) and its verdict, or null.

    ``rules``: (verdict, host, path); a configuration of some hundred at most.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _lexical(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, the lexical features and the host's suffixes."""
    host, path = parts()
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    length = F.length("url")
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    digits = length - F.length(F.translate("url", "0123456789", ""))
    share = F.transform(
        F.filter(F.array_distinct(F.split("url", "")), lambda c: c != ""),
        lambda c: (length - F.length(F.replace(F.col("url"), c, F.lit("")))) / length)
    names = F.split("host", r"\.")
    suffixes = [
        F.array_join(F.slice(names, F.greatest(F.size(names) - k + 1, F.lit(1)), k), ".").alias(f"_suffix_{k}") for k in _SUFFIXES]
    values = [
        length, F.length("host"), F.length("path"), F.when(F.length("host") > 0, F.size(names)).otherwise(0),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")), F.coalesce(digits / F.nullif(length, F.lit(0)), F.lit(0.0)),
        length - F.length(F.translate("url", "-", "")),
        F.coalesce(-F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)), F.lit(0.0)),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")), F.length(query),
    ]
    return out.select("page_id", "url", "host", "path", *[v.cast("double").alias(n) for v, n in zip(values, _LEXICAL)], *suffixes)


def _fold() -> Column:
    return F.pmod(F.xxhash64("page_id", "url"), F.lit(_FOLDS)).alias("_fold")


def _with_suffix_statistics(rows: DataFrame, labelled: DataFrame, prior: float, own: bool) -> DataFrame:
    """``rows`` with the share of unwanted pages by suffix; ``own``: of the other
    folds, for rows that are counted themselves."""
    mean = labelled.agg(F.avg("label")).first()[0] or 0.0
    for k in _SUFFIXES:
        suffix = f"_suffix_{k}"
        by_fold = labelled.groupBy(suffix, _fold()).agg(F.count("*").alias("_n"), F.sum("label").alias("_bad"))
        every = by_fold.groupBy(suffix).agg(F.sum("_n").alias("_all_n"), F.sum("_bad").alias("_all_bad"))
        rows = rows.join(every, suffix, "left")
        bad, n = F.coalesce("_all_bad", F.lit(0.0)), F.coalesce("_all_n", F.lit(0))
        if own:
            rows = rows.withColumn("_fold", _fold()).join(by_fold, [suffix, "_fold"], "left")
            bad, n = bad - F.coalesce("_bad", F.lit(0.0)), n - F.coalesce("_n", F.lit(0))
        rows = rows.withColumn(f"suffix_{k}", (bad + prior * mean) / (n + prior)).drop("_n", "_bad", "_all_n", "_all_bad", "_fold")
    return rows


def train(labelled: DataFrame, prior: float, trees: int, depth: int, rate: float) -> GBTClassificationModel | None:
    """A model of the labelled rows; None if there are not both kinds."""
    kinds = labelled.groupBy("label").count().count()
    if kinds < 2:
        return None
    rows = _with_suffix_statistics(labelled, labelled, prior, own=True)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    # The same rows in the same places for every run.
    ordered = store(vectors.select("page_id", "features", "label"), "training").sort("page_id", "label")
    return GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=rate, seed=7, checkpointInterval=-1).fit(ordered)


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], prior: float = 10.0,
    trees: int = 12, depth: int = 3, rate: float = 0.3, threshold: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict and probability of every page.

    ``pages`` (page_id, url); ``labels`` (page_id, label): 1.0 for unwanted pages.
    """
    rows = store(_lexical(pages), "urls")
    labelled = store(rows.join(labels.select("page_id", F.col("label").cast("double").alias("label")), "page_id"), "labelled")
    model = train(labelled, prior, trees, depth, rate)
    if model is None:
        scored = rows.withColumn("probability", F.lit(0.0))
    else:
        full = _with_suffix_statistics(rows, labelled, prior, own=False)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
        model.setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_predicted")
        scored = model.transform(vectors).withColumn("probability", vector_to_array("_p")[1])
    rule, verdict = rule_of(rules)
    learned = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "probability")
