"""URL filter: host and path rules, then a character language-model ratio.

Rules judge the URLs that they fit; those are also the labelled examples. Two
character models, of accepted and of rejected URLs, are variable-order Markov
models: a character's context is the longest of up to ORDERS characters that
is in the models' tree, and Witten-Bell smoothing mixes its counts with those of
all shorter ones, down to a uniform floor. A context is in the tree if it holds
at least one in CONTEXTS of all labelled characters, so no order has more than
CONTEXTS of them. A URL without a rule is judged by the difference of its
log-likelihoods per character, against the threshold with the least error on
labelled URLs held out of the counts (both classes weigh the same).

DataFrame functions only. All labelled URLs are counted. The tree has a row for
each context and character of the alphabet, so 170,000 rows an order at most,
which are broadcast whatever the input's size.

Defined cases: null URLs and URLs without `://` have empty host and path and
fit no rule; the models judge them like others, but a null URL gets `default`.
So does every URL without a rule if either class has no example.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .line_dedup import LOWER, UPPER

#: Characters the models tell apart, after folding; `^` stands before a URL, `$` after it, `*` for all others.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%+~*^$"
#: Characters of context at most; contexts of each order at most; the least count of one.
ORDERS, CONTEXTS, LEAST = 4, 4000, 4
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def folded(url: Column) -> Column:
    text = F.translate(F.lower(url), "0123456789", "0000000000")
    return F.regexp_replace(text, r"[^a-z0/.\-_?=&#:%+~]", "*")


def grams(urls: DataFrame, *keys: str) -> DataFrame:
    """One row per character and the end: keys, gram (ORDERS before it and itself)."""
    text = F.concat(F.lit("^" * ORDERS), folded(F.col("url")), F.lit("$"))
    out = urls.select(*keys, text.alias("t"))
    out = out.select(*keys, "t", F.explode(F.sequence(F.lit(1), F.length("t") - ORDERS)).alias("i"))
    return out.select(*keys, F.substring("t", F.col("i"), F.lit(ORDERS + 1)).alias("gram"))


def fit(labelled: DataFrame) -> DataFrame:
    """labelled: url, ok (boolean). Returns gram, llr: the log of the ratio of
    both models' probabilities of the gram's last character after the others,
    for each context of the tree and each character."""
    counts = written(grams(labelled, "ok").groupBy("ok", "gram").agg(F.count(F.lit(1)).alias("n")), "url-grams")
    least = F.greatest(F.lit(float(LEAST)), counts.agg((F.coalesce(F.sum("n"), F.lit(0)) / CONTEXTS).alias("x")).scalar())
    letters, classes = F.explode(F.array(*map(F.lit, ALPHABET))), F.explode(F.array(F.lit(True), F.lit(False)))
    trees, before = [], None
    for order in range(ORDERS + 1):
        now = counts.groupBy("ok", F.expr(f"substring(gram, {ORDERS + 1 - order}, {order + 1})").alias("g")).agg(F.sum("n").cast("double").alias("n"))
        totals = now.groupBy("ok", F.expr(f"substring(g, 1, {order})").alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).cast("double").alias("kinds"))
        known = totals.groupBy("ctx").agg(F.sum("total").alias("all")).filter((F.col("all") >= least) | F.lit(order == 0))
        every = known.select("ctx", letters.alias("x")).select("ctx", "x", classes.alias("ok")).withColumn("g", F.concat("ctx", "x"))
        if before is None:
            every = every.withColumn("lower", F.lit(1.0 / len(ALPHABET)))
        else:
            # a context's own end is in the tree too: it occurs as often, or more
            every = every.withColumn("h", F.expr("substring(g, 2)")).join(before.toDF("ok", "h", "lower"), ["ok", "h"])
        every = every.join(totals, ["ok", "ctx"], "left").join(now, ["ok", "g"], "left")
        p = (F.coalesce("n", F.lit(0.0)) + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds"))
        before = written(every.select("ok", "g", F.coalesce(p, "lower").alias("p")), "url-probabilities")
        llr = F.sum(F.when(F.col("ok"), F.log("p"))) - F.sum(F.when(~F.col("ok"), F.log("p")))
        trees.append(before.groupBy(F.col("g").alias("gram")).agg(llr.alias("llr")))
    return written(reduce(DataFrame.union, trees), "url-model")


def ratios(urls: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """keys, ratio: the mean log ratio of each URL's characters. The rows of
    one key stand together, so the sums are made before any shuffle."""
    out = grams(urls, *keys)
    for order in range(ORDERS + 1):
        tree = model.filter(F.length("gram") == order + 1).select(F.col("gram").alias(f"g{order}"), F.col("llr").alias(f"llr{order}"))
        out = out.join(F.broadcast(tree), F.expr(f"substring(gram, {ORDERS + 1 - order})") == F.col(f"g{order}"), "left")
    return out.groupBy(*keys).agg(F.avg(F.coalesce(*(f"llr{order}" for order in range(ORDERS, -1, -1)))).alias("ratio"))


def calibrated(labelled: DataFrame, model: DataFrame) -> float | None:
    """The ratio that parts both classes with the least error, the share of
    accepted URLs below it and of rejected ones from it on; of several, the one
    nearest to the middle between both classes' means. None if a class is
    missing. Ratios are looked at in steps of 1/1024, of which there are few."""
    bins = ratios(labelled, model, "url", "ok").groupBy(F.floor(F.col("ratio") * 1024).alias("bin")).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.sum(F.when(F.col("ok"), F.col("ratio"))).alias("s1"), F.sum(F.when(~F.col("ok"), F.col("ratio"))).alias("s0")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return None
    middle = (sum(r["s1"] or 0.0 for r in bins) / good + sum(r["s0"] or 0.0 for r in bins) / bad) / 2
    below, above, found = 0, bad, []
    edges = [r["bin"] for r in bins] + [bins[-1]["bin"] + 1]
    for k, (low, edge) in enumerate(zip([edges[0], *(e + 1 for e in edges[:-1])], edges, strict=True)):
        # any limit between the end of the bin before and the start of this one has the same error
        limit = min(max(middle, low / 1024), edge / 1024)
        found.append((below * bad + above * good, abs(limit - middle), limit))
        if k < len(bins):
            below, above = below + bins[k]["good"], above - bins[k]["bad"]
    return min(found)[2]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict, ratio for every row of pages.

    The models are fitted on all different URLs with a rule but a fifth, picked
    by hash, that calibrates the threshold. A ratio is kept for the URLs that no rule fits.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("found", rule_for(rules, F.col("host"), F.col("path")))
    labelled = rows.filter("found is not null").select("url", (F.col("found.verdict") == "allow").alias("ok")).distinct()
    held = F.conv(F.substring(F.sha2("url", 256), 1, 8), 16, 10).cast("bigint") % 5 == 0
    model = fit(labelled.filter(~held))
    limit = calibrated(labelled.filter(held), model)

    ruled = rows.filter("found is not null").select("id", "host", "path", "found.rule", "found.verdict", F.lit(None).cast("double").alias("ratio"))
    others = rows.filter("found is null")
    if limit is None:
        judged = others.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    else:
        url_ratio = ratios(others.filter("url is not null").select("url").distinct(), model, "url")
        judged = others.join(url_ratio, "url", "left").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("ratio").isNull(), default).when(F.col("ratio") >= limit, "allow").otherwise("block").alias("verdict"), "ratio")
    return ruled.unionByName(judged).withColumnRenamed("id", id_col)
