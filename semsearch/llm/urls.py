"""URL filters: host and path rules, then association rules over URL tokens."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_not, stored

#: The transaction item that stands for a bad label; no URL token has a blank.
BAD = "bad label"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, path words and query names, each with its place.

    Numbers are one token, as page numbers say nothing of a page.
    """
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    words = F.regexp_extract_all(F.lower(path(url)), F.lit(r"([\p{L}\p{N}_-]+)"), 1)
    names = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    marked = [(labels, "host:"), (F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)), "path:"), (names, "query:")]
    return F.array_distinct(F.concat(*(_prefixed(a, m) for a, m in marked)))


def _prefixed(texts: Column, prefix: str) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))


def alike_tokens(labelled: DataFrame) -> DataFrame:
    """token, alike: the least of all tokens that stand in exactly the same rows of ``labelled`` (_row, tokens).

    The rows of a token are compared by their number and two sums of 64-bit hashes.
    """
    rows = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("_row").alias("_h"))
    in_rows = rows.groupBy("token").agg(F.count("*").alias("_n"), F.bit_xor("_h").alias("_x"), F.sum(F.shiftright("_h", 32)).alias("_s"))
    least = in_rows.groupBy("_n", "_x", "_s").agg(F.min("token").alias("alike"))
    return in_rows.join(least, ["_n", "_x", "_s"]).select("token", "alike")


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_count: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """Token combinations that foretell a bad label: rule_id, antecedent, confidence, support.

    ``labelled`` has ``tokens`` and ``bad`` (boolean).  FP-growth runs on Spark over
    all labelled rows; a rule needs ``min_count`` bad rows, the share ``min_support``
    of all rows, and ``min_confidence``.  So there are at most 1 / min_support disjoint
    ones, and their number doesn't follow the input.  Rules that contain another
    rule are dropped as they match nothing more.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double")
    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = stored(rules.withColumn("rule_id", F.xxhash64("antecedent")), "url-rules")
    # a rule is redundant if the tokens of a shorter one all occur in it: found through the shorter one's first token
    short = rules.select(F.col("antecedent").alias("part"), F.element_at("antecedent", 1).alias("token"))
    longer = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    within = longer.join(short, "token").where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return stored(rules.join(within.select("rule_id").distinct(), "rule_id", "left_anti"), "url-rules")


def matching_rules(urls: DataFrame, rules: DataFrame, id_col: str, alike: DataFrame | None = None) -> DataFrame:
    """Ids of ``urls`` (``id_col``, ``tokens``) that some rule matches, through an inverted index.

    Only tokens of some rule are looked at; ``alike`` gives the token that a rule has
    in place of others.  Every rule is listed under its least common token; a URL looks
    its tokens up and only the rules found there are compared with it.
    """
    used = rules.select(F.explode("antecedent").alias("alike")).distinct()
    names = used.select(F.col("alike").alias("token"), "alike") if alike is None else alike.join(used, "alike").select("token", "alike")
    names = small_or_not(stored(names, "rule-tokens"))
    urls = urls.select(id_col, F.explode("tokens").alias("token")).join(names, "token").groupBy(id_col).agg(F.collect_set("alike").alias("tokens"))
    listed = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    common = listed.groupBy("token").agg(F.count("*").alias("n"))
    index = listed.join(common, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("antecedent").alias("antecedent"))
    index = small_or_not(stored(index.select("token", "antecedent"), "rule-index"))
    looked_up = urls.select(id_col, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0).select(id_col).distinct()


def judge_urls(pages: DataFrame, lists: list[tuple[str, str]], labels: DataFrame, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """A verdict for every row: page_id, host, path, rule, verdict.

    ``lists`` holds (``allow`` or ``block``, ``host/path``).  An entry fits its host
    and all subdomains if the URL's path starts with the entry's; the longest one
    wins, of equal ones the first.  ``labels`` has ``id_col`` and ``bad``; from them
    rules are mined that judge the URLs no entry fits: block if one matches, else allow.
    A null URL, or one without ``://``, has empty host and path and is allowed;
    an id that is null has no label; repeated rows are judged alike; without
    labels nothing is mined.  Other columns are not read.
    """
    urls = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"))
    urls = urls.select("_id", "_url", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, entry in sorted(reversed(lists), key=lambda x: len(x[1])):  # the last one put around the others wins
        name, slash, rest = entry.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(entry)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    urls = urls.withColumn("rule", rule).withColumn("_listed", verdict)
    marked = labels.select(labels[id_col].alias("_id"), labels["bad"].cast("boolean").alias("bad")).where("bad is not null")
    labelled = urls.join(marked, "_id").select(tokens(F.col("_url")).alias("tokens"), "bad").withColumn("_row", F.monotonically_increasing_id())
    labelled = stored(labelled, "labelled-urls")
    # tokens of the same rows, as those of one template, are mined as one, or all their combinations would be
    alike = stored(alike_tokens(labelled), "alike-tokens")
    as_one = labelled.select("_row", "bad", F.explode_outer("tokens").alias("token")).join(alike, "token", "left").groupBy("_row", "bad").agg(F.collect_set("alike").alias("tokens"))
    mined = mine_rules(stored(as_one.select("tokens", "bad"), "transactions"), **mining)
    open_urls = urls.where("_listed is null").select("_url", tokens(F.col("_url")).alias("tokens")).where("_url is not null").distinct()
    blocked = matching_rules(open_urls, mined, "_url", alike).select("_url", F.lit(True).alias("_blocked"))
    return urls.join(blocked, "_url", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_listed", F.when(F.col("_blocked"), F.lit("block")), F.lit("allow")).alias("verdict")
    )
