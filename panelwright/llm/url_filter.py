"""URL filter: host and path rules first, then a character model ratio.

Rules judge the URLs they fit. From those, two smoothed variable-order Markov models are learned, one of accepted and
one of rejected URLs (Witten-Bell: a context of up to ORDER characters gives way to its shorter suffix by the share of
its different followers). A URL without a rule is judged by the difference of its two log-likelihoods, divided by its
length, against a threshold that separates held-out URLs with a rule best.

The log-likelihood is a plain sum over all substrings of up to ORDER + 1 characters: a substring that the model has seen
adds what it changes against its own suffix, and one that is a context adds the weight with which it gives way. So a
model is one table of (string, weight), and a score is one join and one sum. Weights are whole millionths, so that sums
do not depend on their order. A model of measured size is broadcast; beyond BROADCAST_BYTES its frequent strings are,
whose number is bounded, and the others are met by shuffling.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.session import stage

#: The rules of the query, longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 4
#: One in HELD_OUT URLs with a rule is held out for the threshold.
HELD_OUT = 5
START, END, STAND_IN = "\u0002", "\u0003", "\u0001"
MILLION = 1_000_000
#: Scores are thousandths; no log ratio of two smoothed probabilities of this many counts comes near the bound.
STEPS, MOST = 1_000, 60_000
BROADCAST_BYTES = 64 << 20
#: A string with one in HEAD_SHARE of all counted places is frequent: at most HEAD_SHARE strings can be.
HEAD_SHARE = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a domain above it and begins the path; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.when(rule == r[1], F.lit(r[0])).otherwise(c), rules, F.lit(None).cast("string"))


def model_text(url: Column) -> Column:
    """What the models read: the whole URL with A-Z lower-cased between a start and an end mark."""
    return F.concat(F.lit(START), F.translate(F.coalesce(url, F.lit("")), UPPER + START + END, LOWER + STAND_IN * 2), F.lit(END))


def substrings(text: Column, most: int) -> Column:
    """All substrings of 1 to `most` characters, one entry for each place; the start mark alone is among them."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(1, most + 1)])


def string_counts(urls: DataFrame, order: int) -> DataFrame:
    """(s, a, r): places of each substring in accepted and in rejected URLs. urls: (text, verdict)."""
    places = urls.select("verdict", F.explode(substrings(F.col("text"), order + 1)).alias("s"))
    return places.groupBy("s").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))


def string_weights(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, int]:
    """(s, w, n) and the weight of a character that neither model has seen. w > 0 speaks for accepted."""
    seen = stage(counts.where(F.col("s") != START).withColumn("size", F.char_length("s")))
    total = seen.where("size = 1").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.count("*").alias("v")).first()
    base = {c: float(total[c] + total["v"] + 1) for c in "ar"}
    first = seen.where("size = 1").select("s", "a", "r", *[((F.col(c) + 1) / F.lit(base[c])).alias(f"p{c}") for c in "ar"])
    ratio = lambda x, y: F.log(x) - F.log(y)
    parts, below = [first.select("s", (F.col("a") + F.col("r")).alias("n"), ratio(F.col("pa"), F.col("pr")).alias("w"))], stage(first.select("s", "pa", "pr"))
    for size in range(2, order + 2):
        near = Window.partitionBy("context")  # as many rows as characters may follow
        level = seen.where(F.col("size") == size).select("s", "a", "r", F.substring("s", 1, size - 1).alias("context"), F.substring("s", 2, size - 1).alias("suffix"))
        level = level.withColumns({f"n{c}": F.sum(c).over(near) for c in "ar"} | {f"t{c}": F.count_if(F.col(c) > 0).over(near) for c in "ar"})
        lower = below.select(F.col("s").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        level = level.join(lower, "suffix")
        for c in "ar":
            n, t, q = F.col(f"n{c}"), F.col(f"t{c}"), F.col(f"q{c}")
            level = level.withColumn(f"p{c}", F.when(n > 0, (F.col(c) + t * q) / (n + t)).otherwise(q))
            level = level.withColumn(f"l{c}", F.when(n > 0, F.log(t / (n + t))).otherwise(0.0))
            level = level.withColumn(f"g{c}", F.when(F.col(c) > 0, F.log(f"p{c}") - F.col(f"l{c}") - F.log(q)).otherwise(0.0))
        level = stage(level)
        parts.append(level.select("s", (F.col("a") + F.col("r")).alias("n"), (F.col("ga") - F.col("gr")).alias("w")))
        # the start mark alone is a context only; every other context is counted as a string already
        places = F.when(F.col("context") == START, F.max(F.col("na") + F.col("nr"))).otherwise(0)
        parts.append(level.groupBy("context").agg(F.max(F.col("la") - F.col("lr")).alias("w"), places.alias("n")).select(F.col("context").alias("s"), "n", "w"))
        below = level.select("s", "pa", "pr")
    whole = reduce(DataFrame.unionByName, parts).groupBy("s").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    millionths = lambda w: F.floor(w * MILLION + 0.5)
    unseen = counts.sparkSession.range(1).select(millionths(F.log(F.lit(1 / base["a"])) - F.log(F.lit(1 / base["r"])))).first()[0]
    return stage(whole.select("s", millionths(F.col("w")).alias("w"), "n")), unseen


def ratio_scores(urls: DataFrame, weights: DataFrame, unseen: int, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES, head_share: int = HEAD_SHARE) -> DataFrame:
    """(_row, score): thousandths of a nat per character. urls: (_row, text)."""
    places = urls.select("_row", F.explode(substrings(F.col("text"), order + 1)).alias("s"))
    weight = F.coalesce("w", F.when(F.char_length("s") == 1, F.lit(unseen)).otherwise(F.lit(0)))
    size = weights.agg(F.sum(F.octet_length("s") + 48).alias("bytes"), F.sum("n").alias("n")).first()
    table = weights.select("s", "w")
    if (size["bytes"] or 0) <= broadcast_bytes:
        met = places.join(F.broadcast(table), "s", "left").select("_row", weight.alias("w"))
    else:
        head = F.broadcast(weights.where(F.col("n") * head_share >= size["n"]).select("s", "w"))
        rest = places.join(head, "s", "left_anti").join(table, "s", "left")
        met = places.join(head, "s").select("_row", "w").unionByName(rest.select("_row", weight.alias("w")))
    sums = met.groupBy("_row").agg(F.sum("w").alias("w"))
    lengths = urls.select("_row", (F.char_length("text") - 1).cast("double").alias("chars"))
    score = F.floor(F.col("w").cast("double") * STEPS / (F.col("chars") * MILLION))
    return sums.join(lengths, "_row").select("_row", F.greatest(F.least(score, F.lit(MOST)), F.lit(-MOST)).cast("int").alias("score"))


def threshold(scored: DataFrame) -> int:
    """The score from which a URL is accepted: half-way into the gap below the lowest cut of best balanced accuracy.

    scored: (score, verdict). 0 if held-out URLs are missing on either side.
    """
    hist = scored.groupBy("score").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # 2 * MOST + 1 scores at most
    sides = hist.select("score", F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("caught"), F.lag("score").over(Window.orderBy("score")).alias("last"))
    total = hist.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not total["a"] or not total["r"]:
        return 0
    # the same order as balanced accuracy, in whole numbers
    gain = F.col("caught").cast("decimal(38,0)") * F.lit(total["a"]) - F.col("lost").cast("decimal(38,0)") * F.lit(total["r"])
    best = sides.orderBy(gain.desc(), F.col("score").asc()).first()
    return best["score"] if best["last"] is None else (best["last"] + 1 + best["score"]) // 2


def judged_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    order: int = ORDER,
    broadcast_bytes: int = BROADCAST_BYTES,
    head_share: int = HEAD_SHARE,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, and score where the model judged.

    Null and empty URLs have no host and no path and are judged by the model like any text; so are URLs of any length,
    whole. Repeated rows and ids are judged each. With no URL of a kind to learn from, that kind's model is even, and a
    score at the threshold is accepted. An empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    urls = stage(ruled.select("*", verdict_of(F.col("rule"), rules).alias("verdict"), model_text(F.col("_url")).alias("text"), F.monotonically_increasing_id().alias("_row")))
    held = F.crc32(F.coalesce("_url", F.lit(""))) % HELD_OUT == 0
    weights, unseen = string_weights(string_counts(urls.where(F.col("verdict").isNotNull() & ~held), order), order)
    model = (weights, unseen, order, broadcast_bytes, head_share)
    fresh = urls.where(F.col("verdict").isNotNull() & held)
    least = threshold(ratio_scores(fresh, *model).join(fresh.select("_row", "verdict"), "_row"))
    open_urls = urls.where(F.col("verdict").isNull())
    scored = ratio_scores(open_urls, *model)
    by_model = F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block"))
    rest = open_urls.drop("verdict").join(scored, "_row").withColumn("verdict", by_model)
    both = urls.where(F.col("verdict").isNotNull()).withColumn("score", F.lit(None).cast("int")).unionByName(rest, allowMissingColumns=True)
    return both.select(F.col("page_id").alias(id_col), "host", "path", "rule", "verdict", "score")


def drop_blocked(pages: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """The pages whose URL is accepted, with all their columns. Equal URLs get one verdict."""
    judged = judged_urls(pages.select(F.col(url_col).alias("page_id"), F.col(url_col).alias("url")), **options)
    gone = stage(judged.where("verdict = 'block'").select(F.struct("page_id").alias("url")).distinct())
    return pages.join(gone, F.struct(pages[url_col]) == gone["url"], "left_anti")
