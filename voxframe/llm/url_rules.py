"""URL filtering by fixed rules and by association rules that FP-growth mines from labelled URLs.

The fixed rules decide the URLs that they fit, and label them for learning. FP-growth finds the token
combinations that go with a label; rules of enough support and confidence are kept, indexed by their
rarest token, and matched to the other URLs through that index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from .common import UPPER

#: (verdict, host, path) of the fixed rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ALLOW, BLOCK = "label=allow", "label=block"


def host_and_path(url):
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Without ``://`` both are empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def url_tokens(url, host, path):
    """Distinct tokens: the scheme, each part of the host with its place from the right, the path's words with their places, the query's keys and the fragment."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    words = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"\d+", "0")))
    query = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.regexp_extract(x, "^[^=]*", 0)))
    rest = F.array(F.concat(F.lit("s="), F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))), F.concat(F.lit("f="), F.regexp_extract(url, r"#(.*)$", 1)))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(x, empty) for x in (labels, words, query, F.filter(rest, lambda x: x.isNotNull() & ~x.isin("s=", "f="))))))


def fixed_rule(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """(name, verdict) of the longest fixed rule that fits: the host or a subdomain of it, and a path that starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def token_items(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, item): tokens that are in exactly the same rows are one item, named by the first of them; tokens of too little support are left out.

    Which rows a token is in is told by two 64-bit sums of the rows' hashes and their number, added up without carry.
    """
    sets = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("rows"))
    least = labelled.count() * min_support
    each = sets.select(F.explode("tokens").alias("token"), "rows", *(F.xxhash64(F.lit(k), "tokens").alias(f"mark_{k}") for k in (1, 2)))
    seen = each.groupBy("token").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("sets"), *(F.bit_xor(f"mark_{k}").alias(f"mark_{k}") for k in (1, 2))).where(F.col("rows") >= least)
    same = Window.partitionBy("rows", "sets", "mark_1", "mark_2")  # a few thousand tokens: each is in so large a share of the rows
    return seen.select("token", F.min("token").over(same).alias("item"))


def mine(labelled: DataFrame, items: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (antecedent, block, confidence, support, key) from rows of (tokens, verdict), over the items of ``token_items``.

    Every combination of enough support and confidence is a rule, however many items it has. Tokens that always come together are one item, so they make one combination and not
    one for each choice of them; the number of rules still grows with the combinations of items that come together often. ``key``, the antecedent's rarest item, is its posting in the index.
    """
    known = labelled.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("found"))
    rows = labelled.join(known, "tokens", "left").select(F.concat(F.array(F.concat(F.lit("label="), "verdict")), F.coalesce("found", F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    common = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where(F.col("consequent")[0].isin(ALLOW, BLOCK))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), (F.col("consequent")[0] == BLOCK).alias("block"), "confidence", "support")
    rarest = Window.partitionBy("antecedent", "block").orderBy("freq", "token")
    posted = rules.select("*", F.explode("antecedent").alias("token")).join(common, "token").withColumn("_place", F.row_number().over(rarest))
    return posted.where("_place = 1").select("antecedent", "block", "confidence", "support", F.col("token").alias("key"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = 0.005, min_confidence: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL of ``pages``.

    Returns one row per row of ``pages``: id, ``host``, ``path``, ``rule`` (the fixed rule that decided, or null),
    ``verdict`` (``allow`` or ``block``), and ``mined`` and ``confidence``, the tokens and confidence of the mined rule that decided (or
    null). Where no fixed rule fits, the matching mined rule of the highest confidence decides; of equal ones
    that of more support, then the more specific, then one that allows, then the first by its tokens. Where none
    matches, the verdict is ``allow``.

    A null URL or one without ``://`` has empty host and path. Rows that repeat an id are judged alike if
    their URLs are equal. With no labelled URL, or an empty table, no rule is mined. Other columns are not looked at.

    Equal token sets are matched once, so a host with a third of all rows costs no more than its
    different URLs; a rule meets only URLs that have its rarest token.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    urls = stored(urls.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    labelled = urls.where("verdict is not null and size(tokens) > 0")
    sets = urls.where("verdict is null and size(tokens) > 0").select(F.array_sort("tokens").alias("tokens")).distinct()
    nothing = F.lit(None).cast("struct<confidence: double, support: double, n: int, allows: boolean, mined: array<string>>")
    if labelled.limit(1).count():
        labelled = labelled.select("tokens", "verdict")
        items = stored(token_items(labelled, min_support), "url-items")
        mined = stored(mine(labelled, items, min_support, min_confidence), "url-rules")
        # one of an item's tokens is enough, as each of them alone is in the same rows
        own = sets.withColumn("token", F.explode("tokens")).join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"), F.collect_list(F.struct("item", "token")).alias("pairs"))
        hits = own.withColumn("key", F.explode("items")).join(mined, "key").where(F.size(F.array_except("antecedent", "items")) == 0)
        told = F.array_sort(F.transform(F.filter("pairs", lambda p: F.array_contains("antecedent", p["item"])), lambda p: p["token"]))
        hits = hits.select("tokens", "confidence", "support", "block", told.alias("mined"))
        rank = F.struct("confidence", "support", F.size("mined").alias("n"), (~F.col("block")).alias("allows"), "mined")
        best = hits.groupBy("tokens").agg(F.max(rank).alias("best"))
        # only URLs that no fixed rule decides look for a mined one
        open_ = urls.where("verdict is null").withColumn("tokens", F.array_sort("tokens")).join(best, "tokens", "left").select(*urls.columns, "best")
        out = urls.where("verdict is not null").withColumn("best", nothing).unionByName(open_)
    else:
        out = urls.withColumn("best", nothing)
    decided = F.coalesce("verdict", F.when(F.col("best.allows") == F.lit(False), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", decided.alias("verdict"), F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))
