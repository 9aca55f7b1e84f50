"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the URLs that no rule decides.

Everything here is DataFrame functions and Spark's own boosted trees (spark.ml); no Python runs on the executors. Host and path are cut out of the URL, rules are tested as an expression, and the trees see lengths, depth, shares of digits and letters, entropy, counts of parameters, labels and symbols, and statistics of suffixes: how often the last one and two labels of the host, and the first segment of the path, were blocked among the labelled URLs.

The trees are fitted on at most ``SAMPLE`` labelled URLs, those with the smallest hashes; the statistics of suffixes count all labelled URLs, in tables that grow with them and are joined by sorting. Every URL is judged, each distinct one once, on its whole text.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by the trees; a long URL counts whole in every feature; a URL that is labelled both ways counts as blocked; of equal hashes the smaller URL is fitted on; without both labels among the labelled URLs the verdict is allow; repeated rows are judged alike; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise

SAMPLE = 10_000
ROUNDS, DEPTH, STEP = 12, 4, 0.3
#: Weight of the overall share in a suffix's statistic, in URLs.
PRIOR = 20.0

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1), CAPITALS, SMALL), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (action, host, path) that fits, as a struct of rule and verdict, or null. rules are a short list, tested longest first in one expression."""
    tested = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        tested = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))).otherwise(tested)
    return tested


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that a URL alone has."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    # -sum p log2 p = log2 n - (1/n) sum over the characters of log2 of how often each occurs, from the runs of the sorted characters in one pass.
    chars = F.array_sort(F.split(u, ""))
    n = F.greatest(F.size(chars), F.lit(1))
    told = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0)
    start = F.struct(F.lit("").alias("char"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.when(acc["char"] == c, F.struct(c.alias("char"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))).otherwise(F.struct(c.alias("char"), F.lit(1.0).alias("run"), (acc["sum"] + told(acc["run"])).alias("sum")))
    entropy = F.log2(n) - F.aggregate(chars, start, step, lambda acc: acc["sum"] + told(acc["run"])) / n
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    return {
        "url_length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "depth": F.size(parts),
        "labels": F.size(labels),
        "longest_part": F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)),
        "digit_share": _share(r"\d", u),
        "host_digit_share": _share(r"\d", host),
        "symbol_share": _share(r"[^A-Za-z0-9]", u),
        "upper_share": _share(r"[A-Z]", u),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "escapes": F.regexp_count(u, F.lit("%[0-9A-Fa-f]{2}")),
        "has_fragment": F.contains(u, F.lit("#")).cast("int"),
        "is_https": F.startswith(u, F.lit("https:")).cast("int"),
        "entropy": entropy,
    }


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {
        "suffix": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "segment": F.coalesce(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0)), F.lit("")),
    }


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """pages (page_id, url, ...) with __url_host, __url_path, __rule and __verdict (allow or block).

    labelled: url, blocked (0 or 1). Without it, the URLs that the rules decide are the labelled ones, so the trees carry the rules' policy over to URLs like those."""
    rows = pages.select(F.struct("*").alias("row"), F.col("url").cast("string").alias("url"))
    h, p = F.col("host"), F.col("path")
    placed = lambda df: df.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    at = materialise(placed(rows.select("url").distinct()).withColumn("hit", matching_rule(h, p, rules)))
    if labelled is None:
        known = at.filter("hit is not null and url is not null").select("url", "host", "path", (F.col("hit.verdict") == "block").cast("int").alias("blocked"))
    else:
        known = labelled.filter("url is not null and blocked is not null").groupBy(F.col("url").cast("string").alias("url")).agg(F.max("blocked").cast("int").alias("blocked"))
        known = materialise(placed(known))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if not 0 < ones < n:
        judged = at.withColumn("blocks", F.lit(False))
    else:
        base, numbers = ones / n, lexical(F.col("url"), h, p)
        names, rates = [*numbers, *(f"{k}_{x}" for k in _suffixes(h, p) for x in ("rate", "seen"))], {}
        for k, c in _suffixes(h, p).items():
            counted = known.groupBy(c.alias(k)).agg(F.sum("blocked").alias("ones"), F.count("*").alias("n"))
            rates[k] = materialise(counted.select(k, ((F.col("ones") + PRIOR * base) / (F.col("n") + PRIOR)).alias(f"{k}_rate"), F.log1p(F.col("n").cast("double")).alias(f"{k}_seen")))

        def featured(df: DataFrame) -> DataFrame:
            df = df.withColumns({k: c.cast("double") for k, c in numbers.items()} | _suffixes(h, p))
            for k, rate in rates.items():
                df = df.hint("merge").join(rate, k, "left").fillna({f"{k}_rate": base, f"{k}_seen": 0.0})
            return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df.drop(*rates))

        chosen = known.orderBy(F.xxhash64("url"), "url").limit(sample)
        chosen = featured(chosen).select("blocked", "features").repartition(1).cache()
        trees = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=11)
        judged = trees.fit(chosen).transform(featured(at)).withColumn("blocks", F.col("prediction") == 1.0)
        chosen.unpersist()
    by_method = F.when(F.col("blocks"), "block").otherwise("allow")
    judged = judged.select(F.col("url").alias("of"), h.alias("__url_host"), p.alias("__url_path"), F.col("hit.rule").alias("__rule"), F.coalesce("hit.verdict", by_method).alias("__verdict"))
    return rows.hint("merge").join(judged, rows["url"].eqNullSafe(judged["of"])).select("row.*", "__url_host", "__url_path", "__rule", "__verdict")
