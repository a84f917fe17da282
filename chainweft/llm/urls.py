"""URL filter: association rules over URL tokens, beside a curated list of hosts and paths.

Curated rules decide first, the longest that fits. Labelled URLs (those that curated rules
decide, or any other labels) become baskets of tokens with their verdict. Spark's FP-growth
mines frequent token sets; the rules with a verdict on the right are pruned by support,
confidence and generality. An inverted index (each rule under its rarest token) finds the rules
of a URL, and the most confident one decides. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.session import materialise

#: Verdict, host and path of the curated rules.
CURATED = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of labelled URLs that a token set is in, confidence, and tokens on the left.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 0.9, 3
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def curated_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = CURATED) -> Column:
    """Verdict and text (``rule``) of the longest rule whose host is the URL's or above it and whose path begins the URL's."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, words of them and of the path, keys of the query. Numbers are left out."""
    words = F.split(host, r"[.\-]")
    labels = F.split(host, r"\.")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    tokens = F.concat(
        F.transform(words, lambda w: F.concat(F.lit("h:"), w)),
        F.transform(F.filter(labels, lambda w: w.contains("-")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(F.split(F.translate(path, _UPPER, _LOWER), r"[/.\-_]"), lambda w: F.concat(F.lit("p:"), w)),
        F.transform(query, lambda w: F.concat(F.lit("q:"), F.split(w, "=")[0])),
    )
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.rlike(r"^.:[0-9]+$"))))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules ``tokens``, ``verdict``, ``confidence``, ``support`` from ``labelled`` (``tokens``, ``verdict``).

    A rule goes if another with the same verdict asks for fewer of its tokens and is as confident.
    Without labelled rows there are none.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    if baskets.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = (
        model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= max_tokens))
        .where(~F.exists("antecedent", lambda t: t.startswith("=")))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence", "support")
    )
    rules = materialise(rules, "rules")
    # every proper subset of a rule's tokens, at most 2 ** max_tokens of them, looks for its own rule
    subsets = rules.select("tokens", "verdict", "confidence", F.explode(_subsets()).alias("less"))
    general = rules.select(F.col("tokens").alias("less"), "verdict", F.col("confidence").alias("other"))
    covered = subsets.join(general, ["less", "verdict"]).where("other >= confidence").select("tokens", "verdict").distinct()
    return materialise(rules.join(covered, ["tokens", "verdict"], "left_anti"), "rules")


def _subsets() -> Column:
    """Proper non-empty subsets of ``tokens``, each in order, one for each bit mask."""
    return F.expr("""transform(CASE WHEN size(tokens) > 1 THEN sequence(1, shiftleft(1, size(tokens)) - 2) ELSE array() END,
        m -> filter(tokens, (t, i) -> shiftright(m, i) % 2 = 1))""")


def judged(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = CURATED, **limits: float) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule``, ``confidence`` for every page.

    The curated rule decides where one fits. Else the most confident mined rule does (ties: block,
    then more support, then the first in order), and without any the verdict is ``allow``.
    ``labels`` (``page_id``, ``verdict``) adds to what the curated rules label. A null URL or one
    without ``://`` has an empty host and path and no tokens. Repeated rows are judged alike.
    """
    base = pages.select("page_id", F.col("url").cast("string").alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("given", curated_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.when(F.col("host") != "", tokens_of(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    labelled = base.where("given IS NOT NULL").select("tokens", "given.verdict")
    if labels is not None:
        own = labels.select("page_id", F.col("verdict").alias("verdict")).where("verdict IS NOT NULL").distinct()
        labelled = labelled.unionByName(base.join(own, "page_id").select("tokens", "verdict"))
    found = mined(labelled, **limits)
    # each rule stands in the index under its rarest token, so common tokens find few rules
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    index = (
        found.select("tokens", "verdict", "confidence", "support", F.explode("tokens").alias("token")).join(often, "token")
        .groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    )
    # URLs with the same open tokens are judged once
    open_ = base.where("given IS NULL").select("tokens").distinct()
    hits = open_.select(F.col("tokens").alias("page_tokens"), F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("tokens", "page_tokens")) == 0)
    rank = F.struct("confidence", (F.col("verdict") == "block").alias("block"), "support", F.col("tokens"))
    best = hits.groupBy("page_tokens").agg(F.max_by(F.struct("verdict", "confidence", "tokens"), rank).alias("best"))
    out = base.join(best, F.col("given").isNull() & (F.col("tokens") == F.col("page_tokens")), "left")
    return out.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.array_join("best.tokens", " ").alias("mined_rule"), F.col("best.confidence").alias("confidence"),
    )
