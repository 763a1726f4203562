"""Filter URLs: rules first, and for the rest gradient-boosted trees on lexical features, learned from labelled URLs.

Features: lengths of url, host, path and longest label, depth, ratio of digits, character entropy, counts of parameters,
labels, hyphens and escapes, whether there is a fragment, and suffix statistics: for the last label of the host, the last
two, and the last two with the first part of the path, how often the suffix occurs among labelled URLs and the smoothed
share of blocked ones. The statistics cover all labelled URLs; only the trees are fitted on a sample, at most
``FIT_ROWS`` labelled rows, those with the smallest hash.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features like others; equal urls get equal verdicts, and every row is returned; without labelled URLs, or with one kind
of them, the rest is allowed, or gets that one kind; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.llm.files import stored, whole_row

FIT_ROWS = 20_000
TREES, DEPTH = 20, 4
PRIOR = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the production filter.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict), or null. ``rules`` is a short list kept in the plan."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.greatest(b, F.lit(1)), F.lit(0.0))


def entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.char_length(text)
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", (n - F.char_length(F.replace(text, c, F.lit("")))) / n))
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda a, p: a - F.coalesce(p * F.log2(p), F.lit(0.0))), F.lit(0.0))


FEATURES = ("length", "host_length", "path_length", "longest_label", "depth", "digits", "host_digits", "entropy", "parameters", "labels", "hyphens", "escapes", "fragment")
SUFFIXES = ("suffix1", "suffix2", "suffix3")


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, lexical features and the three suffixes."""
    u = F.coalesce(F.col(url), F.lit(""))
    rows = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    digits = lambda t: F.char_length(t) - F.char_length(F.translate(t, "0123456789", ""))
    count = lambda t, c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    two = F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    values = {
        "length": F.char_length(u), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "longest_label": F.array_max(F.transform(labels, F.char_length)), "depth": count(path, "/"),
        "digits": ratio(digits(u), F.char_length(u)), "host_digits": ratio(digits(host), F.char_length(host)), "entropy": entropy(u),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "labels": F.size(labels),
        "hyphens": count(host, "-"), "escapes": count(u, "%"), "fragment": F.when(u.contains("#"), 1).otherwise(0),
    }
    rows = rows.withColumns({k: v.cast("double") for k, v in values.items()})
    return rows.withColumns({"suffix1": F.element_at(labels, -1), "suffix2": two, "suffix3": F.concat(two, F.lit("/"), F.regexp_extract(path, "^/([^/]*)", 1))})


@dataclass
class UrlModel:
    """Suffix statistics (one table per suffix) and trees; without trees ``constant`` is the score."""

    statistics: dict[str, DataFrame]
    trees: GBTClassificationModel | None
    constant: float
    prior: float

    def inputs(self, rows: DataFrame) -> DataFrame:
        for s, table in self.statistics.items():
            rows = rows.join(table, s, "left").withColumns({f"{s}_share": F.coalesce(f"{s}_share", F.lit(self.prior)), f"{s}_count": F.log1p(F.coalesce(f"{s}_count", F.lit(0)).cast("double"))})
        names = [*FEATURES, *(f"{s}_{k}" for s in self.statistics for k in ("share", "count"))]
        return VectorAssembler(inputCols=names, outputCol="_inputs").transform(rows).drop(*names)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (from ``with_features``) with ``score``, the probability of block."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.constant))
        out = self.trees.transform(self.inputs(rows))
        return out.withColumn("score", vector_to_array("_p")[1]).drop("_inputs", "_raw", "_p", "_prediction")


def fit_urls(labelled: DataFrame, rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Learn from rows with features (``with_features``) and ``label`` (1: block)."""
    labelled = stored(labelled, "labelled_urls")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = blocked / n if n else 0.0
    statistics = {}
    for s in SUFFIXES:
        share = (F.sum("label") + PRIOR * prior) / (F.count("*") + PRIOR)
        statistics[s] = stored(labelled.groupBy(s).agg(share.alias(f"{s}_share"), F.count("*").alias(f"{s}_count")), s)
    model = UrlModel(statistics, None, float(prior), prior)
    if 0 < blocked < n:
        sample = labelled.orderBy(F.xxhash64("url"), "url").limit(rows)  # one partition, as its size is bounded
        fitter = GBTClassifier(featuresCol="_inputs", labelCol="label", predictionCol="_prediction", maxIter=trees, maxDepth=depth, seed=1)
        fitter = fitter.setProbabilityCol("_p").setRawPredictionCol("_raw")
        data = stored(model.inputs(sample).select("_inputs", "label").coalesce(1), "fit_urls")
        if data.select("label").distinct().count() == 2:
            model.trees = fitter.fit(data)
    return model


def judged(urls: DataFrame, rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """``urls`` with host, path, rule, verdict and score, in place of columns of that name.

    Without a model, one is learned from the rows that rules decide.
    """
    others = urls.drop("host", "path", "rule", "verdict", "score")
    rows = with_features(urls.select(whole_row(others), "url")).withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        labelled = rows.filter("_rule is not null").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
        model = fit_urls(labelled.select("url", *FEATURES, *SUFFIXES, "label"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    out = model.score(rows).withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", own)})
    return out.select("whole.*", "host", "path", "rule", "verdict", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "score")
