"""URL filter: a list of host and path rules, and, for what they leave open, association rules that FP-growth mines from labelled urls."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# A mined rule needs this share and this number of the labelled urls, and this part of those it fits must be bad.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 20, 0.6
BAD = "label=block"


def parsed(pages: DataFrame) -> DataFrame:
    """host and path of each url; both empty for null and where there is no ://."""
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    rows = pages.withColumn("_rest", F.coalesce(after, F.lit("")))
    host = F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER)
    return rows.withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def listed(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """The distinct tokens of a url: scheme, host, top domain, the host's words, words of the path with digits made one, names in the query."""
    low = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    named = lambda kind, x: F.transform(x, lambda w: F.concat(F.lit(kind + "="), w))
    kept = lambda x: F.filter(x, lambda w: w != "")
    path = F.regexp_replace(F.translate("path", UPPER, LOWER), r"[0-9]+", "0")
    query = F.regexp_replace(F.regexp_extract(low, r"\?([^#]*)", 1), r"=[^&]*", "")
    return F.array_distinct(
        F.concat(
            named("scheme", kept(F.array(F.regexp_extract(low, r"^([a-z]+)://", 1)))), named("host", kept(F.array("host"))),
            named("top", kept(F.array(F.regexp_extract("host", r"([^.]*)$", 1)))), named("word", kept(F.split("host", r"[.\-]"))),
            named("path", kept(F.split(path, r"[/.\-_]"))), named("query", kept(F.split(query, "&"))),
        )
    )


def mine(pages: DataFrame, labels: DataFrame, min_support=MIN_SUPPORT, min_count=MIN_COUNT, min_confidence=MIN_CONFIDENCE) -> DataFrame:
    """(items, confidence, count) of the token combinations that mark a bad page. Labelled are the pages whose page_id a label's doc_id names; bad
    are those of low quality or toxic. Rules under the support, the count or the confidence are pruned, and so are those with a part that is as sure."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    baskets = stored(pages.join(marks, "page_id").select(F.concat("tokens", F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.expr("array()"))).alias("items")), "baskets")
    shape = "items array<string>, confidence double, count long"
    if not baskets.head(1):
        return pages.sparkSession.createDataFrame([], shape)
    sets = stored(FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    whole = sets.filter(~F.array_contains("items", BAD)).withColumnRenamed("freq", "total")
    bad = sets.filter(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("items"), "freq")
    sure = bad.join(whole, "items").withColumn("confidence", F.col("freq") / F.col("total"))
    sure = stored(sure.filter((F.col("freq") >= min_count) & (F.col("confidence") >= min_confidence)).select("items", "confidence", F.col("freq").alias("count")), "rules")
    # a rule goes if one of its items can be left out without loss; its parts, as frequent at least, are all in the table
    parts = sure.select("items", "confidence", F.explode("items").alias("out")).select(
        F.col("items").alias("whole"), F.col("confidence").alias("whole_confidence"), F.array_remove("items", F.col("out")).alias("items")
    )
    idle = parts.join(sure, "items").filter("confidence >= whole_confidence").select(F.col("whole").alias("items")).distinct()
    return sure.join(idle, "items", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, confidence): the surest mined rule of each distinct url. A rule is indexed under its rarest token among the rules, so
    that a url meets a rule through one token; the tokens of a url are checked against all of the rule."""
    often = rules.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    lead = rules.select("items", "confidence", "count", F.explode("items").alias("token")).join(often, "token")
    index = lead.groupBy("items", "confidence", "count").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    urls = pages.select("url", "tokens", F.explode("tokens").alias("token"))
    met = urls.join(index, "token").filter(F.size(F.array_intersect("items", "tokens")) == F.size("items"))
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "count", F.array_join("items", " ").alias("rule"))).alias("best"))
    return best.select("url", F.col("best.rule").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) for every row.

    The verdict is that of the longest listed rule that fits, else block if a mined rule fits, else allow. A null url, or one without ://, has empty host and path and
    no tokens of them, and is judged like any other. Rows that repeat a url are judged alike; rows without page_id are judged but not learned from. Without
    labels nothing is mined and the verdict is allow."""
    rule, verdict = listed(rules)
    rows = parsed(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("rule", rule).withColumn("listed", verdict)
    rows = stored(rows.withColumn("tokens", tokens()), "urls")
    mined = mine(rows, labels)
    open_rows = rows.filter("rule IS NULL AND url IS NOT NULL").select("url", "tokens").dropDuplicates(["url"])
    found = matched(open_rows, mined)
    both = rows.join(found, "url", "left")
    return both.select(
        "page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
