"""URL filters: a list of host and path rules, and association rules mined from the urls that the list decides.

The list is met by keys: every suffix of a host's labels, with the beginnings of the path that are as long as some rule's
path, so that a url meets just the rules that fit it; the longest wins. Where none fits, the method decides: the tokens of
a url (labels of the host, words of the path, names in the query) are items, the verdict of a decided url is one more, and
Spark's FP-growth mines which tokens go with which verdict. Rules stay that have the support and the confidence asked for
and no part that says the same at least as surely. They are kept in an inverted index under their rarest token: a url meets
the rules of its own tokens, those whose tokens it has all are rules that hit, and the surest of them decides.

All work is on different urls, however often a url is repeated; verdicts are written and meet the pages by url.

Bounds: rules are fitted on about `sample` decided urls at most, chosen by hash; every url is judged. Tokens that are in
the very same urls of the sample are one item (named by the least of them), as they can make no difference; without that,
k of them would make 2^k item sets.

Defined results: a null url, or one without "://", has empty host and path, meets no rule of the list and has no tokens;
a url that no rule of either kind decides is allowed; rules of equal length go by host, then "block" wins; equally sure
rules go by support, then fewer tokens, then "block" wins; without decided urls nothing is mined; repeated rows are judged
alike and stay as many; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import durable, durable_table, table

#: (host, path, verdict): a rule of the list fits its host and all below it, and all paths that begin with its own.
Listed = tuple[str, str, str]
#: Mined rules sent to all tasks, at most: beyond, index and tokens meet by a shuffle.
BROADCAST_RULES = 1 << 16


@dataclass(frozen=True)
class Mining:
    """Shares that a rule needs of the urls (support) and of those with its tokens (confidence), and urls to mine."""

    support: float = 0.002
    confidence: float = 0.8
    sample: int = 200_000


def lower(text: Column) -> Column:
    """A-Z as a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(urls: DataFrame) -> DataFrame:
    """(url, host, path) of urls without nulls."""
    after = F.when(F.contains("url", F.lit("://")), F.regexp_replace("url", r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(F.col("after"), r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring("after", F.length(host) + 1, F.length("after")), r"(?s)^[^?#]*", 0)
    return urls.withColumn("after", after).select("url", lower(host).alias("host"), path.alias("path"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What a url is made of, each once: host labels, words of the path (digits as one 0), names in the query."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host "), x))
    words = F.transform(F.regexp_extract_all(path, F.lit(r"[^/._\-]+"), F.lit(0)), lambda x: F.concat(F.lit("path "), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("query "), x))
    return F.array_distinct(F.concat(labels, words, F.when(F.contains(url, F.lit("://")), names).otherwise(F.array().cast("array<string>"))))


def list_verdicts(urls: DataFrame, rules: Sequence[Listed]) -> DataFrame:
    """(url, host, path, rule, verdict), the last two null where no rule of the list fits; urls (url, host, path) once each."""
    known = urls.sparkSession.createDataFrame([(h, p, h + p, v, len(p)) for h, p, v in rules], "r_host string, r_path string, rule string, verdict string, size int")
    sizes = sorted({len(p) for _, p, _ in rules})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("r_host"))
    keys = keys.select("url", "r_host", F.explode(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes]) if sizes else F.array().cast("array<string>")).alias("r_path"))
    best = F.max(F.struct(F.length("rule").alias("size"), F.length("r_host").alias("of_host"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best")
    fits = keys.where("r_path is not null").join(known.drop("size"), ["r_host", "r_path"]).groupBy("url").agg(best)
    return urls.join(fits, "url", "left").select("url", "host", "path", "best.rule", "best.verdict")


def mine(decided: DataFrame, settings: Mining = Mining()) -> DataFrame:
    """(tokens, verdict, confidence, support) of the rules that stay; decided has (url, tokens, verdict), each url once."""
    spark = decided.sparkSession
    known = decided.count()
    share = min(1.0, settings.sample / max(known, 1))
    chosen = durable(decided.where(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)))
    # Tokens with the same urls: equal counts and equal sums of two hashes of their urls.
    bits = [F.sum(F.pmod(F.xxhash64("url", F.lit(k)), F.lit(1 << 40))).alias(f"h{k}") for k in range(2)]
    where = chosen.select("url", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *bits)
    enough = F.lit(settings.support * chosen.count())
    named = durable(where.where(F.col("n") >= enough).groupBy("n", "h0", "h1").agg(F.min("token").alias("token")).select("token"))
    items = chosen.select("url", "verdict", F.explode("tokens").alias("token")).join(named, "token")  # Spark sends the names while they are few
    items = items.groupBy("url", "verdict").agg(F.collect_set("token").alias("tokens")).select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    if items.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=settings.support, minConfidence=settings.confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 1 << 20).alias("verdict"), "confidence", "support")
    return durable(_without_weaker(durable(found)))


def _index(rules: DataFrame) -> DataFrame:
    """Rules with a token to look them up by: the one that the fewest rules have, the least of equal ones."""
    used = rules.select(F.explode("tokens").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    every = rules.select("tokens", "verdict", F.explode("tokens").alias("key")).join(used, "key")
    keys = every.groupBy("tokens", "verdict").agg(F.min(F.struct("uses", "key"))["key"].alias("key"))
    return rules.join(keys, ["tokens", "verdict"])


def _hits(urls: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, rule): the rules whose tokens are all among the row's tokens, `have`."""
    index = _index(rules).select("key", F.struct("tokens", "verdict", "confidence", "support").alias("rule"))
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index
    met = urls.select(*columns, "have", F.explode("have").alias("key")).join(index, "key")
    return met.where(F.size(F.array_except(F.col("rule")["tokens"], F.col("have"))) == 0).select(*columns, "rule")


def _without_weaker(rules: DataFrame) -> DataFrame:
    """Rules but those with a smaller rule of the same verdict inside that is at least as sure."""
    longer = rules.where(F.size("tokens") > 1).select(F.col("tokens").alias("have"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    inside = _hits(longer, rules, ["have", "v", "c"])
    r = F.col("rule")
    weaker = inside.where((r["verdict"] == F.col("v")) & (r["confidence"] >= F.col("c")) & (F.size(r["tokens"]) < F.size("have")))
    return rules.join(weaker.select(F.col("have").alias("tokens"), F.col("v").alias("verdict")).distinct(), ["tokens", "verdict"], "left_anti")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, have, ...), once each, with verdict and reason: of the surest rule that hits, "allow" and null without one."""
    r = F.col("rule")
    sure = F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), (-F.size(r["tokens"])).alias("few"), (r["verdict"] == "block").alias("blocks"), F.array_join(r["tokens"], ", ").alias("reason"), r["verdict"].alias("verdict"))
    best = _hits(urls, rules, ["url"]).groupBy("url").agg(F.max(sure).alias("best"))
    return urls.join(best, "url", "left").select(urls["*"], F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), "best.reason")


def judge_urls(pages: DataFrame, listed: Sequence[Listed], settings: Mining = Mining(), id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(id, url, host, path, rule, verdict, reason) of every row; rule is the list's, reason the tokens of the mined one.

    Rules are mined from `labelled` (url, verdict; of unlike verdicts of a url the largest), or else from the list's verdicts."""
    every = pages.select(F.coalesce(url_col, F.lit("")).alias("url")).distinct()
    judged = durable_table(list_verdicts(parts(every), listed))
    have = judged.withColumn("have", tokens(F.col("url"), F.col("host"), F.col("path")))
    if labelled is None:
        taught = have.where("verdict is not null")
    else:
        known = labelled.where("url is not null and verdict is not null").groupBy("url").agg(F.max("verdict").alias("verdict"))
        taught = parts(known.select("url")).join(known, "url").withColumn("have", tokens(F.col("url"), F.col("host"), F.col("path")))
    rules = mine(taught.select("url", F.col("have").alias("tokens"), "verdict"), settings)
    mined = mined_verdicts(have.where("verdict is null").drop("verdict"), rules).select("url", "host", "path", "rule", "verdict", "reason")
    verdicts = durable_table(judged.where("verdict is not null").select("*", F.lit(None).cast("string").alias("reason")).unionByName(mined))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("given"), F.coalesce(url_col, F.lit("")).alias("url"))
    return rows.join(verdicts, "url").select(F.col(id_col), F.col("given").alias(url_col), "host", "path", "rule", "verdict", "reason")


OP12_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op12_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the five rules of the list, and by what those decide where none fits."""
    return judge_urls(table(spark, sf_dir, "pages"), OP12_RULES).select("page_id", "host", "path", "rule", "verdict", "reason")
