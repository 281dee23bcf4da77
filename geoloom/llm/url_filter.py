"""URL filtering by mined association rules and by host/path rules; DataFrame and SQL functions only.

Labelled pages become transactions of URL tokens (words of the whole host, path and query keys) plus
an item for a bad label. Of tokens on the same pages one is kept, and Spark's FP-growth mines
frequent combinations; rules `tokens -> bad` that pass confidence and lift are kept,
and of nested ones only the shortest. They match through an inverted index from each rule's rarest
token, so a page looks at those rules only whose rarest token it has.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import materialize

#: Production parameters of the miner. An itemset needs this share of the labelled pages, so how many
#: tokens are frequent, and with them the rules, doesn't grow with the number of pages.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.6, 2.0
#: A combination also needs so many labelled pages, so that a handful never makes a rule.
MIN_PAGES = 25
BAD = "label=bad"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The words of a URL: of all host labels, of the whole path (numbers as #), and all query keys."""
    h, p = host(url), path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    named = lambda name, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(f"{name}="), w))
    words = F.transform(F.split(F.lower(p), r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w))
    return F.array_distinct(F.concat(named("host", F.split(h, r"[.-]")), named("path", words), named("key", F.transform(F.split(query, "&"), lambda k: F.substring_index(k, "=", 1)))))


def frequent(seen: DataFrame, least: int) -> DataFrame:
    """(token) of seen (row, tokens, bad) on so many bad pages at least: others are in no rule.

    Of tokens that stand on the same pages the first stands for all, so that no combination is mined
    many times over.
    """
    page = F.xxhash64("row")
    each = seen.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("n_bad"), F.bit_xor(page).alias("pages"), F.sum(F.shiftrightunsigned(page, 20)).alias("more"))
    return each.where(F.col("n_bad") >= least).groupBy("n", "n_bad", "pages", "more").agg(F.min("token").alias("token")).select("token")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(antecedent, confidence, support, lift) of rules for bad pages; labelled has tokens and bad (boolean)."""
    seen = materialize(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    pages = seen.count()
    least = max(MIN_PAGES, -int(-min_support * pages // 1))
    kept = seen.select("row", F.explode("tokens").alias("token")).join(frequent(seen, least), "token").groupBy("row").agg(F.collect_list("token").alias("tokens"))
    baskets = seen.select("row", "bad").join(kept, "row", "left").select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = materialize(baskets, "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, pages)), minConfidence=min_confidence).fit(baskets)
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(F.col("lift") >= min_lift).select("antecedent", "confidence", "support", "lift")


def inverted_index(rules: DataFrame) -> dict[str, list[list[str]]]:
    """Rarest token -> antecedents, of nested ones the shortest. Rules are bounded by their support (see MIN_SUPPORT)."""
    found = sorted((sorted(r[0]) for r in rules.select("antecedent").collect()), key=lambda a: (len(a), a))
    often = Counter(t for a in found for t in a)
    index: dict[str, list[list[str]]] = {}
    for a in found:
        if not any(set(k) <= set(a) for t in a for k in index.get(t, ())):
            index.setdefault(min(a, key=lambda t: (often[t], t)), []).append(a)
    return index


def matches(tokens_: Column, index: dict[str, list[list[str]]]) -> Column:
    """Whether all tokens of any rule are there."""
    table = F.from_json(F.lit(json.dumps(index)), "map<string,array<array<string>>>")
    hits = F.flatten(F.transform(F.filter(tokens_, lambda t: F.map_contains_key(table, t)), lambda t: F.element_at(table, t)))
    return F.exists(hits, lambda a: F.size(F.array_except(a, tokens_)) == 0) if index else F.lit(False)


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", **mining: float) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict (allow or block).

    rules are (verdict, host, path): a rule fits its host and all subdomains when the path starts
    with its path, and the longest (host and path together) wins. Where none fits, mined rules
    decide; labelled has url and bad. Null URLs and URLs without :// have empty host and path, no
    tokens, and are allowed. Rows are judged one by one: repeats and null ids stay as they are.
    Without labelled rows no rules are mined.
    """
    seen = labelled.select(tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    index = inverted_index(mine_rules(seen, **mining))
    d = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_u")).select(id_col, host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"), tokens(F.col("_u")).alias("_tokens"))
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    mined = F.when(matches(F.col("_tokens"), index), F.lit("block")).otherwise(F.lit("allow"))
    return d.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
