"""URL filter: fixed rules by host and path, then association rules mined by FP-growth.

Labelled URLs become baskets of tokens (host labels by their place from the right, path words, query keys, a fragment)
plus their label; Spark's parallel FP-growth finds the frequent sets.  Tokens that are frequent with the label are the
only ones a rule can hold, so the others go first; and tokens that come with exactly the same URLs are one (the first of
them stands for all), or each of them would double the number of sets.  A set with the label `block` gives the rule
"these tokens -> block", whose confidence is its count over that of the tokens alone.  Rules below the least support,
confidence or lift go, and so do rules that a subset matches with no less confidence; none goes for its length.  Matching is by
inverted index: each rule is listed under its rarest token, URLs meet only the rules listed under their own tokens, and
the rest of the tokens is then verified.

Lift is a rule's confidence over the share of bad URLs; where that share is so high that no confidence reaches the least
lift, a confidence of 1 does.

Cases: null urls and urls without `://` have empty host and path, no tokens and the verdict allow; repeated rows get
equal verdicts; null ids are kept; urls of any length are read whole; without labels or frequent sets there are no mined
rules; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, stored

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.001, 20, 0.6, 1.5
LABEL = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; host labels are numbered from the right, so none implies another."""
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    words = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    keys = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: x != "")
    out = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), (i + 1).cast("string"), F.lit("="), x)),
        F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1))),
        F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(out)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules (tokens array, support count, confidence) from labelled(url, bad boolean)."""
    spark = labelled.sparkSession
    schema = "tokens array<string>, support long, confidence double"
    rows = labelled.filter("bad is not null").select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("tokens"), "bad")
    rows = stored(rows, "baskets")
    total, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(min_support * total, min_count)
    if bad < least:
        return spark.createDataFrame([], schema)
    # a token of a rule is in `least` bad URLs; those with equal URLs (count, and sum of hashes of their rows) are one
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    tally = each.groupBy("token").agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)])
    tally = stored(tally.filter(F.col("bad") >= least), "frequent-tokens")
    first = tally.groupBy("n", "s0", "s1").agg(F.min("token").alias("token"))
    kept = checked(stored(first.select("token"), "kept-tokens"))
    baskets = each.join(kept, "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.first("bad").alias("bad"))  # one URL's tokens
    baskets = stored(baskets.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items")), "frequent-baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], schema)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = stored(sets.select(F.array_sort("items").alias("items"), "freq"), "frequent-sets")
    with_ = sets.filter(F.array_contains("items", LABEL) & (F.size("items") > 1)).select(F.array_remove("items", LABEL).alias("tokens"), F.col("freq").alias("support"))
    rules = with_.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").withColumn("confidence", F.col("support") / F.col("freq"))
    rules = stored(rules.filter(F.col("confidence") >= max(min_confidence, min(1.0, min_lift * bad / total))).select("tokens", "support", "confidence"), "raw-rules")
    # a rule falls to a proper subset of at least its confidence: the greatest confidence of all its subsets is carried up, one token at a time
    size = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    whole = sets.filter(~F.array_contains("items", LABEL)).select(F.col("items").alias("tokens"))  # subsets that are no rules pass their own subsets' on
    best = whole.join(rules, "tokens", "left").select("tokens", F.coalesce("confidence", F.lit(0.0)).alias("own"))
    known = stored(best.filter(F.size("tokens") == 1).select("tokens", "own", F.lit(0.0).alias("below")), "rule-level")
    out = known
    for k in range(2, size + 1):
        here = best.filter(F.size("tokens") == k)
        subs = here.select("tokens", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("sub"))
        below = subs.join(known.select(F.col("tokens").alias("sub"), F.greatest("own", "below").alias("b")), "sub").groupBy("tokens").agg(F.max("b").alias("below"))
        known = stored(here.join(below, "tokens").select("tokens", "own", "below"), "rule-level")
        out = out.union(known)
    kept = out.filter("own > below").select("tokens")
    return stored(rules.join(kept, "tokens", "left_semi"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined rule, confidence): the surest rule of each different url that has one."""
    tokens = urls.select("url").filter("url is not null").distinct().withColumn("tokens", tokens_of(F.col("url")))
    counts = stored(rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "rule-tokens")
    ranked = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(counts, "token")
    index = ranked.groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("rare"), F.max("confidence").alias("confidence"), F.max("support").alias("support"))
    index = stored(index.select(F.col("rare.token").alias("token"), F.col("tokens").alias("rule"), "confidence", "support"), "rule-index")
    met = tokens.select("url", "tokens", F.explode("tokens").alias("token")).join(checked(index), "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", "rule")).alias("best"))
    return best.select("url", F.array_join("best.rule", " ").alias("mined"), F.col("best.confidence").alias("confidence"))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest of rules [(verdict, 'host/path')] that fits, else null."""
    each = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        each.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*each).cast("array<struct<size:int,rule:string,verdict:string>>"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every row of pages(page_id, url)."""
    p = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    p = p.withColumn("fixed", listed(F.col("host"), F.col("path"), rules))
    found = stored(match(p, mined), "mined-verdicts").withColumnRenamed("url", "_u")
    out = p.join(found, F.col("url") == F.col("_u"), "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined", "confidence")


#: Fixed rules of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's path names a document by number; it is bad if that document is marked poor or toxic."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*[^?#]*?/([0-9]+)', 1) as bigint)")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).filter("bad is not null")
    return pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "bad")


def query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, RULES, mine(labelled_urls(pages, labels)))
