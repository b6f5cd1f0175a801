"""URL filters by association rules: combinations of URL tokens that FP-growth finds to go with rejected pages."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, written

MIN_SUPPORT, MIN_CONFIDENCE = 5, 0.5  # rejected pages that a rule rests on, however many are labelled
SENT = 50_000  # rules that are broadcast; more are joined
BAD = "!"  # the item of a rejected page; no token begins like this


def tokens(url: Column) -> Column:
    """Host, its labels (h:), path segments (p:, digits as 0), query parameters (q:); lower case, distinct and sorted."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(bare, r"^[^?#]*\?([^#]*)", 1)

    def marked(part: Column, sep: str, mark: str) -> Column:
        return F.transform(F.filter(F.split(part, sep), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    paths = marked(F.regexp_replace(path, r"\d+", "0"), "/", "p:")
    all_ = F.concat(marked(host, r"$", "host:"), marked(host, r"\.", "h:"), paths, marked(query, "&", "q:"))
    return F.array_sort(F.array_distinct(F.coalesce(all_, F.array().cast("array<string>"))))


def _labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, tokens and whether it is rejected; an id with several labels is rejected if any of them says so."""
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False))).alias("bad"))
    return pages.join(bad, pages["page_id"] == bad["doc_id"]).select("page_id", "tokens", "bad")


def mine(labelled: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule, confidence, support) of the rules that are left after pruning, written. rule has sorted tokens.

    A rule holds if its tokens and a rejection meet on at least min_support labelled pages, and at least min_confidence of
    the pages with its tokens are rejected. It is pruned if fewer of its tokens have as high a confidence, so combinations
    go on as long as confidence rises. Tokens that occur on the very same labelled pages are mined as one.
    """
    flat = labelled.select("page_id", "bad", F.explode("tokens").alias("token"))
    seen = flat.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("b"), F.bit_xor(F.xxhash64("page_id")).alias("x"), F.bit_xor(F.xxhash64("page_id", F.lit(1))).alias("y"))
    alike = written(seen.where(F.col("b") >= min_support).groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("all")).select(F.col("all")[0].alias("token"), "all"), "token-classes")
    kept = flat.join(alike.select("token"), "token").groupBy("page_id", "bad").agg(F.collect_list("token").alias("t"))
    items = written(kept.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items")), "url-items")
    n = items.count()
    schema = "rule array<string>, confidence double, support bigint"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    share = min(1.0, max(1e-12, (min_support - 0.5) / n))
    sets = written(FPGrowth(itemsCol="items", minSupport=share).fit(items).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("support"))
    odds = written(bad.join(sets, "items").select("items", "support", (F.col("support") / F.col("freq")).alias("confidence")), "url-odds")
    sizes = sorted(r[0] for r in odds.select(F.size("items").alias("k")).distinct().collect())
    levels, below = [], None
    for k in sizes:  # best: the highest confidence of a set or of any part of it
        own = odds.where(F.size("items") == k)
        if below is None:
            level = own.withColumn("part", F.lit(-1.0))
        else:
            parts = own.select(F.col("items").alias("whole"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items"))
            level = own.join(parts.join(below, "items").groupBy("whole").agg(F.max("best").alias("part")).withColumnRenamed("whole", "items"), "items")
        levels.append(written(level.withColumn("best", F.greatest("confidence", "part")), "url-level"))
        below = levels[-1].select("items", "best")
    found = None
    for level in levels:
        own = level.where((F.col("confidence") >= min_confidence - 1e-12) & (F.col("confidence") > F.col("part")))
        found = own if found is None else found.union(own)
    if found is None:
        return labelled.sparkSession.createDataFrame([], schema)
    whole = found.select("items", "confidence", "support", F.explode("items").alias("token")).join(alike, "token").groupBy("items", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("rule"))
    out = written(whole.select("rule", "confidence", "support"), "url-rules")
    discard(alike, items, sets, odds, *levels)
    return out


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, best (confidence, support, rule) and n_rules of each set of tokens that a rule fits.

    The inverted index has a rule under the one of its tokens that the fewest rules have.
    """
    one = rules.select("*", F.explode("rule").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("often"))
    index = one.join(often, "token").groupBy("rule", "confidence", "support").agg(F.min(F.struct("often", "token")).alias("key")).select(F.col("key.token").alias("key"), "rule", "confidence", "support")
    index = F.broadcast(index) if rules.count() <= SENT else index
    asked = pages.select("tokens").where(F.size("tokens") > 0).distinct().select("tokens", F.explode("tokens").alias("key"))
    hits = asked.join(index, "key").where(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("rule").alias("rule"))).alias("best")
    return hits.groupBy("tokens").agg(best, F.count("*").cast("int").alias("n_rules"))


def url_rules(pages: DataFrame, labels: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row a page: page_id, blocked, and of the best rule that fits confidence, support, its tokens; n_rules that fit.

    labels (doc_id, quality, toxic) are those of the page of that id; quality 0 or toxic 1 is a rejection. The best rule
    has the highest confidence, then support, then the first tokens. Null and empty URLs have no tokens and are never
    blocked; URLs of any length are taken whole; null labels reject nothing; repeated pages and null ids are kept, but a repeated page
    teaches once; other columns are ignored; without pages there are no rows, without labels no page is blocked.
    """
    pages = pick(pages, page_id="bigint", url="string").select("page_id", tokens(F.col("url")).alias("tokens"))
    labels = pick(labels, doc_id="bigint", quality="int", toxic="int").where("doc_id is not null")
    labelled = written(_labelled(pages, labels).distinct(), "labelled-urls")
    hit = matched(pages, mine(labelled, min_support, min_confidence))
    out = pages.join(hit, "tokens", "left")
    discard(labelled)
    return out.select("page_id", F.col("best").isNotNull().alias("blocked"), (-F.col("best.c")).alias("confidence"), (-F.col("best.s")).alias("support"), F.coalesce("best.rule", F.array().cast("array<string>")).alias("rule"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
