"""URL filters: rules, and for the rest the ratio of two character language models, in DataFrame operations alone.

The whole urls that rules allow or block train one smoothed variable-order Markov model each. A character is judged after the
longest context that either model has seen with it; a url's score is the mean difference of the two log-likelihoods,
compared with a threshold calibrated on labelled urls that the models didn't see. Differences are rounded to millionths,
so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, missing, small

#: Characters of context, at most; counts of pseudo-characters that the shorter context adds; size of the alphabet.
ORDER, PSEUDO, ALPHABET = 4, 4.0, 128
MICRO = 1_000_000
#: Characters of a piece that urls are cut into.
PIECE = 1000
#: Millionths in a bin of the calibration's histogram; scores count as at most so many bins from 0.
BIN, BINS = 10_000, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. rules: (verdict, host and path), a list written by hand.

    A rule fits its host and the hosts below it, where the path starts with the rule's. Of two rules alike, the first counts.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(dict((t, v) for v, t in reversed(rules)).items(), key=lambda x: len(x[0])):
        r_host, r_path = said.partition("/")[0], "/" + said.partition("/")[2]
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        rule, verdict = F.when(fits, F.lit(said)).otherwise(rule), F.when(fits, F.lit(text)).otherwise(verdict)
    return rule, verdict


def places(urls: DataFrame, *keep: str) -> DataFrame:
    """keep..., piece, pos: a row for each character of ``url`` but the mark before its first, with the piece of the url that it is in.

    A piece has the ORDER characters before its own, so that what ends at ``pos`` is in it. Looking a place up takes time by the
    piece's length, not by the url's, and no row holds a whole url.
    """
    u = F.concat(F.lit("\u0002"), F.col("url"), F.lit("\u0003"))
    rows = urls.select(*keep, u.alias("u"), F.explode(F.sequence(F.lit(0), F.floor((F.length("url")) / PIECE).cast("int"))).alias("p"))
    first = F.lit(2) + F.col("p") * PIECE  # the first character of its own, from 1
    start = F.greatest(F.lit(1), first - ORDER)
    rows = rows.select(*keep, F.substring(F.col("u"), start, first - start + PIECE).alias("piece"), (first - start + 1).alias("from"))
    return rows.select(*keep, "piece", F.explode(F.sequence("from", F.length("piece"))).alias("pos"))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """For each character of ``url`` and each order, the n-gram that ends there: keep..., gram."""
    each = F.array(*[F.when(F.col("pos") > k, F.substring(F.col("piece"), F.col("pos") - k, F.lit(k + 1))) for k in range(ORDER + 1)])
    return places(urls, *keep).select(*keep, F.explode(F.filter(each, lambda g: g.isNotNull())).alias("gram"))


def train(labelled: DataFrame) -> DataFrame:
    """(gram, micro): millionths of the difference of the log-likelihoods of a gram's last character after the others.

    labelled: url, accepted. All rows are counted. With one class alone or none: no rows, and scores are 0.
    """
    n = grams(labelled, "accepted").groupBy("gram").agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    n = cut(n)
    contexts = n.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    contexts = cut(contexts)
    model = lower = None
    for k in range(ORDER + 1):
        level = n.where(F.length("gram") == k + 1).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).join(contexts, "context")
        if k:
            level = level.withColumn("short", F.expr("substring(gram, 2)")).join(lower, "short")
        else:
            level = level.withColumns({"pa": F.lit(1 / ALPHABET), "pr": F.lit(1 / ALPHABET)})
        level = level.select("gram", *[((F.col(c) + PSEUDO * F.col(p)) / (F.col(t) + PSEUDO)).alias(p) for c, t, p in (("a", "ca", "pa"), ("r", "cr", "pr"))])
        level = cut(level)
        lower = level.withColumnRenamed("gram", "short")
        model = level if model is None else model.unionByName(level)
    both = contexts.where("context = ''").where("ca > 0 and cr > 0").select(F.lit(1).alias("one"))
    return cut(model.withColumn("one", F.lit(1)).join(F.broadcast(both), "one").select("gram", F.floor((F.log("pa") - F.log("pr")) * MICRO + 0.5).cast("long").alias("micro")))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score) for each distinct url: the mean over its characters, in millionths, rounded down.

    A character and the ORDER before it are a window. The same windows come again and again, so each is looked up in the model
    once, after the longest context that is there; urls then meet windows, one row a character.
    """
    parts = max(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), urls.sparkSession.sparkContext.defaultParallelism)
    # short rows of which each becomes a hundred: so many partitions, whatever their bytes
    urls = urls.select("url").repartition(parts, "url").distinct().withColumn("id", F.unhex(F.sha2("url", 256)))
    window = F.substring(F.col("piece"), F.greatest(F.col("pos") - ORDER, F.lit(1)), F.least(F.col("pos"), F.lit(ORDER + 1)))
    at = places(urls, "id").select("id", window.alias("window"))
    ends = F.array(*[F.when(F.length("window") > k, F.substring(F.col("window"), F.length("window") - k, F.lit(k + 1))) for k in range(ORDER + 1)])
    known = at.select("window").distinct().select("window", F.explode(F.filter(ends, lambda g: g.isNotNull())).alias("gram")).join(small(model), "gram")
    best = cut(known.groupBy("window").agg(F.max_by("micro", F.length("gram")).alias("micro")))
    means = at.join(small(best), "window", "left").groupBy("id").agg(F.floor(F.coalesce(F.sum("micro"), F.lit(0)) / F.count(F.lit(1))).cast("long").alias("score"))
    return urls.join(means, "id").select("url", "score")


def calibrate(scored: DataFrame) -> int:
    """The threshold with the least sum of the two classes' error rates, from a histogram of scores: accept from it on.

    scored: score, accepted. Scores beyond BINS bins from 0 are told apart no further here; urls are judged by their own. Of equal thresholds the one nearest to 0. Without rows of both classes: 0.
    """
    bin_of = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN)))
    rows = scored.groupBy(bin_of.cast("int").alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).orderBy("bin").collect()  # 4001 rows at most
    all_a, all_r = sum(x.a for x in rows), sum(x.r for x in rows)
    if not all_a or not all_r:
        return 0
    below_a = below_r = 0
    found = []
    for x in rows:  # the threshold at the lower edge of this bin
        found.append((below_a * all_r + (all_r - below_r) * all_a, abs(x.bin), x.bin))
        below_a, below_r = below_a + x.a, below_r + x.r
    return min(found)[2] * BIN


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score for each row of ``pages``.

    Rules see host and path, the models the whole url. Null url, or none with ``://``: host and path are empty and no rule fits;
    a null url is judged as the empty text. Very long urls take time in proportion to their length. Rows that repeat: each. Null page_id: stays null. An empty table gives none. Other columns aren't read. Where a rule fits, score
    is null. If rules don't label both classes, what they don't decide is allowed.
    """
    missing(pages, "page_id", "url")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("url"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumns({"rule": rule, "said": said}))
    labelled = rows.where("said is not null").select("url", (F.col("said") == "allow").alias("accepted"))
    unseen = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % 5 == 0  # a fifth of the labelled urls is for the calibration
    model = train(labelled.where(~unseen))
    check = labelled.where(unseen).distinct()
    threshold = calibrate(score(check, model).join(check, "url"))
    rest = rows.where("said is null")
    scored = score(rest, model).withColumnRenamed("url", "s_url")
    rest = rest.join(scored, F.col("url") == F.col("s_url")).withColumn("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    decided = rows.where("said is not null").withColumns({"score": F.lit(None).cast("long"), "verdict": F.col("said")})
    out = ["page_id", "host", "path", "rule", "verdict", "score"]
    return decided.select(*out).unionByName(rest.select(*out))
