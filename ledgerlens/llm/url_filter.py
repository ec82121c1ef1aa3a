"""URL filter: host and path rules, and gradient-boosted trees for the urls that no rule fits.

The trees learn from the urls that rules label, on lexical features: lengths, depth, digit ratio,
entropy, numbers of parameters, and how often urls of the same host suffix are blocked. Everything
is built-in column functions and Spark's own boosted trees.

Null urls and urls without `://` have an empty host and path; no rule fits them. Rows are judged
one by one, so repeated rows have equal verdicts. If the labelled urls are all of one kind, all
others get that verdict; without any they are allowed. Urls of any length are features of a few
numbers. Result columns take the place of columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._spark import cut, quoted, without

# A host with its path, and what becomes of its pages.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Labelled urls that are learned from, host suffixes with a rate of their own, trees and their depth.
SAMPLE, SUFFIXES, TREES, DEPTH = 20_000, 1_000, 12, 4
#: Rules that are a chain of conditions: more are joined as a table, which finds the same ones.
MOST_RULES = 500
RESULTS = ["host", "path", "rule", "verdict", "score"]
FEATURES = ["_length", "_host_length", "_path_length", "_labels", "_depth", "_digits", "_hyphens", "_params", "_secure", "_entropy", "_rate1", "_rate2"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or above it, and with whose path the url's begins; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_rule(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """urls (host, path) with rule and ruled, its verdict."""
    if len(rules) <= MOST_RULES:
        verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
        urls = urls.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
        return urls.withColumn("ruled", F.lit(None).cast("string") if verdicts is None else verdicts[F.col("rule")])
    split = [(name, slash + rest, rule, verdict) for rule, verdict in rules.items() for name, slash, rest in [rule.partition("/")]]
    table = urls.sparkSession.createDataFrame(split, "_name string, _start string, rule string, ruled string")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    places = urls.select("host", "path").distinct().withColumn("_name", F.explode(F.array_distinct(above)))
    places = places.join(table, "_name").where(F.col("path").startswith(F.col("_start")))
    longest = places.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("_best"))
    return urls.join(longest.select("host", "path", "_best.rule", "_best.ruled"), ["host", "path"], "left")


def _suffix(n: int) -> Column:
    return F.substring_index("host", ".", -n)


def _lexical(urls: DataFrame, url: str) -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / n
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    columns = {
        "_length": F.length(text).cast("double"), "_host_length": F.length("host").cast("double"), "_path_length": F.length("path").cast("double"),
        "_labels": F.size(F.split("host", r"\.")).cast("double"), "_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
        "_digits": count("0-9") / n, "_hyphens": count(r"\-_"), "_params": count("=&"), "_secure": F.lower(text).startswith("https").cast("double"), "_entropy": entropy,
    }
    return urls.withColumns(columns)


@dataclass
class UrlModel:
    """Block rates of the commonest host suffixes, the base rate, and trees unless all labels agree."""

    rates: list[tuple[int, str, float]]
    base: float
    trees: GBTClassificationModel | None


def _with_rates(urls: DataFrame, model: UrlModel) -> DataFrame:
    for n in (1, 2):
        known = [(s, r) for k, s, r in model.rates if k == n] or [("", model.base)]
        table = F.broadcast(urls.sparkSession.createDataFrame(known, f"_s{n} string, _r{n} double"))
        urls = urls.join(table, _suffix(n) == F.col(f"_s{n}"), "left").withColumn(f"_rate{n}", F.coalesce(f"_r{n}", F.lit(model.base))).drop(f"_s{n}", f"_r{n}")
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(urls).drop(*FEATURES)


def fit(urls: DataFrame, url: str = "url", rules: dict[str, str] | None = None, sample: int = SAMPLE) -> UrlModel:
    """Learns from the urls that rules label: at most `sample`, the first by hash."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url))
    urls = urls.select(F.col(url).alias("url")).withColumns({"host": host, "path": path})
    labelled = with_rule(urls, rules).where("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("double")).orderBy(F.xxhash64("url"), "url").limit(sample)
    labelled = cut(labelled.select("url", "host", "path", "label"))
    kinds = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    base = kinds.get(1.0, 0) / max(1, sum(kinds.values()))
    rates = []
    for n in (1, 2):
        counted = labelled.groupBy(_suffix(n).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        rates += [(n, r["s"], (r["blocked"] + 5 * base) / (r["n"] + 5)) for r in counted.orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()]
    model = UrlModel(rates, base, None)
    if len(kinds) == 2:
        trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False)
        model.trees = trees.fit(_with_rates(_lexical(labelled, "url"), model).select("_features", "label"))
    return model


def judge(urls: DataFrame, model: UrlModel, url: str = "url", rules: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of urls (all, by default), host, path, rule, verdict and score, the trees' chance that it is blocked."""
    rules = RULES if rules is None else rules
    keep = without(urls.columns if keep is None else keep, RESULTS)
    host, path = host_and_path(F.col("_url"))
    # other names than the caller's: features and rules have columns of their own
    rows = urls.select(*quoted(*keep), F.col(quoted(url)[0]).alias("_url")).toDF(*(f"_c{i}" for i in range(len(keep))), "_url")
    rows = with_rule(rows.withColumns({"host": host, "path": path}), rules)
    if model.trees is not None:
        from pyspark.ml.functions import vector_to_array

        rows = model.trees.transform(_with_rates(_lexical(rows, "_url"), model)).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("score", F.lit(model.base))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select(*(f"_c{i}" for i in range(len(keep))), "host", "path", "rule", verdict.alias("verdict"), "score").toDF(*keep, *RESULTS)
