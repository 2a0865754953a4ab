"""URL filters: fixed host rules, and association rules that FP-growth mines from labelled urls.

A url is a set of tokens: scheme, each domain that its host lies in, host labels and their words, path segments (numbers
aside), query arguments. A labelled url that is bad gets the item BLOCK. From the frequent itemsets with BLOCK come rules
"these tokens -> block"; a rule stays if its confidence and support suffice and no rule of one token less has as much
confidence. Rules are indexed by their rarest token, urls look their tokens up in the index, and a rule fits where all of
its tokens are there. Every step is a DataFrame operation.

Null urls, and those without ``://``, have an empty host and path and no tokens; they are allowed. Repeated rows keep
their number. Labels for a url count once however often they repeat: it is bad if any of its labels says so. Without
labels, or with none bad, nothing is blocked beyond the fixed rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resgraph.llm.common import staged

#: Host rules, the longest that fits wins.
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BLOCK = "=block"
MIN_SUPPORT = 0.004
MIN_COUNT = 20
MIN_CONFIDENCE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = HOST_RULES) -> Column:
    """The longest rule (struct of rule and verdict) whose host is this one or a parent domain and whose path starts this one; else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, without nulls."""
    host = host_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    domains = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.filter(F.split(path_of(url), r"[/.]"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    arguments = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    every = F.array_distinct(F.concat(scheme, domains, words, steps, arguments))
    return F.when(url.contains("://"), every).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules (key, antecedent, confidence, support) from labelled urls (url string, bad boolean).

    Itemsets need the share min_support of the urls, and min_count of them, so that few labels don't make rules of chance.
    At most (tokens of a url / min_support) tokens are frequent, whatever the number of urls, so rules are few.
    """
    items = labelled.where("url is not null").select(F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    share = min(1.0, max(min_support, min_count / max(1, items.count())))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(items)
    sets = staged(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")), "itemsets")
    plain = sets.where(~F.array_contains("items", BLOCK))
    blocked = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("support"))
    rules = blocked.join(plain, "items").select("items", "support", (F.col("support") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    smaller = rules.select("items", "confidence", F.explode("items").alias("x")).select("items", "confidence", F.array_remove("items", F.col("x")).alias("less"))
    beaten = smaller.join(rules.select(F.col("items").alias("less"), F.col("confidence").alias("c")), "less").where("c >= confidence").select("items").distinct()
    kept = rules.join(beaten, "items", "left_anti")
    single = plain.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), F.col("freq").alias("n"))
    keyed = kept.select("items", "support", "confidence", F.explode("items").alias("token")).join(single, "token")
    index = keyed.groupBy("items", "support", "confidence").agg(F.min(F.struct("n", "token")).alias("k"))
    return staged(index.select(F.col("k.token").alias("key"), F.col("items").alias("antecedent"), "confidence", "support"), "url-rules")


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", fixed: tuple[tuple[str, str], ...] = HOST_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) of every row of pages."""
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("fit", host_rule(F.col("host"), F.col("path"), fixed))
    look = rows.where("fit is null").select("id", "url", tokens(F.col("url")).alias("tokens"))
    look = look.select("id", "url", "tokens", F.explode("tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = look.groupBy(F.col("id").alias("i"), F.col("url").alias("u")).agg(F.max("confidence").alias("confidence"))
    out = rows.join(best, F.col("id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")), "left")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), mined).alias("verdict"), "confidence")


def labelled(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", doc: str = "doc_id") -> DataFrame:
    """(url, bad) of the pages that labels cover: bad if a label of the page's id says low quality or toxic."""
    bad = labels.groupBy(F.col(f"`{doc}`").alias("id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    return pages.select(F.col(f"`{page}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url")).join(bad, "id").select("url", "bad")
