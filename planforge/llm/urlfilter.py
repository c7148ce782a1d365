"""URL filters: host and path rules, and association rules that FP-growth mines from labelled URLs.

A URL's tokens are its scheme, host labels by their distance from the end, path segments with digits
folded, the file ending of the last segment and query keys. FP-growth finds combinations of tokens, joined with the outcome
as one more item; a combination blocks if enough of its rows are bad (confidence) and there are
enough of them (support). Combinations whose part already blocks are pruned. A URL is
matched through an inverted index from token to rule. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.llm.common import saved, table

#: Host, path, verdict. A rule's name is host and path.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BAD = "outcome=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path starts the path, as a struct (rule, verdict); else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Host labels, path segments and query keys that are tokens of their own; further ones make one token together.
OWN = 4


def _numbered(name: str, parts: Column, sep: str) -> Column:
    """name0=, name1=, ... for the first OWN parts, and one token for all others."""
    own = F.transform(F.slice(parts, 1, OWN), lambda x, i: F.concat(F.lit(name), i.cast("string"), F.lit("="), x))
    rest = F.array_join(F.slice(parts, OWN + 1, F.greatest(F.size(parts), F.lit(1))), sep)
    return F.concat(own, F.when(F.size(parts) > OWN, F.array(F.concat(F.lit(f"{name}{OWN}="), rest))).otherwise(F.array().cast("array<string>")))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, at most 3 * OWN + 5 however long it is; none for null."""
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")))
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    ending = F.lower(F.regexp_extract(path, r"/[^/]+\.([^./]+)\z", 1))
    none = F.array().cast("array<string>")
    tokens = F.concat(
        F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^(.*?)://", 1))))).otherwise(none),
        _numbered("host", labels, "."),
        _numbered("path", parts, "/"),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(none),
        F.transform(F.slice(keys, 1, OWN), lambda x: F.concat(F.lit("key="), x)),
        F.when(F.size(keys) > OWN, F.array(F.concat(F.lit("keys="), F.array_join(F.slice(keys, OWN + 1, F.greatest(F.size(keys), F.lit(1))), "&")))).otherwise(none),
    )
    return F.coalesce(F.array_distinct(tokens), none)


RULE_SCHEMA = T.StructType(
    [T.StructField("rule_id", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("probe", T.StringType()), T.StructField("support", T.LongType()), T.StructField("confidence", T.DoubleType())]
)


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = 0.002, min_confidence: float = 0.6, least: int = 5) -> DataFrame:
    """Rules (rule_id, tokens, probe, support, confidence) that tell bad URLs, mined over all labelled rows.

    `bad` is boolean or 0/1; rows with a null there or without tokens don't count. A rule needs
    max(least, min_support * rows) rows with its tokens and the bad outcome. A rule that holds a rule of one token, or of one token
    less than it has, is pruned. No labelled rows give no rules. `probe` is the rule's rarest token.

    A token that is a rule by itself, or is in too few bad rows to be part of any, is settled before FP-growth, which sees
    bad rows and the rest of the tokens. A URL has a bounded number of tokens and each token set counted is in at least
    min_support of the rows, so the sets are bounded too.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(bad).isNotNull()).select(tokens_of(F.col(url)).alias("t"), F.col(bad).cast("boolean").alias("b")).where(F.size("t") > 0)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RULE_SCHEMA)
    need = max(least, min_support * n)
    single = rows.select(F.explode("t").alias("token"), "b").groupBy("token").agg(F.count("*").alias("seen"), F.count_if("b").alias("support")).where(F.col("support") >= need)
    single = saved(single.withColumn("sure", F.col("support") / F.col("seen") >= min_confidence), "tokens")
    sure = single.where("sure").select(F.array("token").alias("tokens"), F.col("token").alias("probe"), "support", (F.col("support") / F.col("seen")).alias("confidence"))
    # The tokens that may be part of longer rules; there are at most 1 / min_support times a URL's tokens of them. One
    # that all rows have changes no count.
    usable = F.broadcast(single.where(~F.col("sure") & (F.col("seen") < n)).select("token", "seen"))
    items = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "b", F.explode("t").alias("token")).join(usable.select("token"), "token").groupBy("row", "b").agg(F.collect_list("token").alias("items"))
    items = saved(items.where(F.size("items") > 1).select("items", "b"), "transactions")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, need / max(1, n))).fit(items.where("b").select("items").unionByName(_padding(spark, items, n))).freqItemsets
    sets = saved(sets.where(F.size("items") > 1).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("support")), "sets")
    # How often each set is seen in all rows: looked up by its rarest token.
    probe = sets.select("tokens", "support", F.explode("tokens").alias("token")).join(F.broadcast(usable), "token").groupBy("tokens", "support").agg(F.min_by("token", F.struct("seen", "token")).alias("probe"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small in bytes, but each pair takes time
    spread = items.select("items", F.explode("items").alias("probe")).repartition(parts, "probe")
    seen = spread.join(probe.repartition(parts, "probe").hint("merge"), "probe").where(F.size(F.array_except("tokens", "items")) == 0).groupBy("tokens", "support", "probe").agg(F.count("*").alias("seen"))
    rules = seen.withColumn("confidence", F.col("support") / F.col("seen")).where(F.col("confidence") >= min_confidence).drop("seen")
    rules = saved(rules, "rules")
    # Prune: a rule whose tokens hold those of a rule with one token less adds nothing.
    shorter = rules.select(F.col("tokens").alias("inner")).distinct()
    over = rules.select("tokens", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("inner")).join(shorter, "inner").select("tokens").distinct()
    rules = rules.join(over, "tokens", "left_anti").select("tokens", "probe", "support", "confidence").unionByName(sure)
    return rules.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "probe", "support", "confidence")


def _padding(spark: SparkSession, items: DataFrame, n: int) -> DataFrame:
    """Empty transactions, so that the share of all labelled rows is what FP-growth compares with its support."""
    empty = n - items.where("b").count()
    return spark.range(max(0, empty)).select(F.array().cast("array<string>").alias("items"))


def matching(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, confidence) of the different urls that some rule blocks, with the highest confidence.

    The inverted index holds each rule under its rarest token, so a token that all urls have leads to few rules.
    """
    index = rules.select(F.col("probe").alias("token"), F.col("tokens").alias("need"), "confidence")
    own = urls.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("t", tokens_of(F.col("url")))
    hits = own.select("url", "t", F.explode("t").alias("token")).join(index, "token").where(F.size(F.array_except("need", "t")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add `host`, `path`, `rule` and `verdict`: the fixed rule's, else block where mined rules match, else allow.

    Pages with an empty or null url are allowed unless a rule says otherwise. Every row is judged by its own url, so
    repeated rows are judged alike and repeated ids each by themselves. A url of any length is read whole. Columns of these
    names are replaced, all others stay. An empty table returns no rows.
    """
    out = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    out = out.withColumn("__fit", fitting(F.col("host"), F.col("path")))
    mined = matching(pages, rules, url).select(F.col("url").alias("__url"), F.lit(True).alias("__blocked"))
    out = out.join(mined, F.col(url) == F.col("__url"), "left")
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__blocked"), "block").otherwise("allow"))
    return out.withColumn("rule", F.col("__fit.rule")).withColumn("verdict", verdict).drop("__fit", "__url", "__blocked")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict. The mined rules learn from all pages whose id has a label: quality 0 or toxic 1 is bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.join(labels, pages.page_id == labels.doc_id)
    return judge(pages, mine(labelled)).select("page_id", "host", "path", "rule", "verdict")
