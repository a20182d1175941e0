"""URL filters: a fixed rule list first, then association rules over URL tokens.

1. A URL that fits rules of the list gets the verdict of the longest one.
2. The tokens of a URL are its host labels and the words of its path and of the
   rest; numbers count as one token.  Tokens that stand in exactly the same labelled
   URLs are one item, so a long repeated URL does not multiply combinations.
3. FP-growth over the labelled URLs' items and their label gives combinations
   with enough support; those that end in a label with enough confidence are rules.
   A rule whose combination less one item is as confident is dropped: it could
   change no verdict.  Where a labelled URL has more than ``MAX_ITEMS`` items, all
   combinations would be too many, and Spark grows them an item at a time, all
   labelled URLs alike: projected baskets are summed, and a combination is left only
   when neither it nor any longer one can be such a rule.
4. An inverted index files a rule under its rarest token.  The distinct token sets
   of all URLs are looked up by token and hold a rule if they hold all its tokens.
   The most confident rule held gives the verdict (then more labelled URLs, fewer
   tokens, block before allow); without any it is ``DEFAULT``.

Labels: a page shows the document whose number stands in its path; it is labelled
block where ``labels`` marks that document as toxic or of low quality, else allow.

Bounds: none; ``MAX_ITEMS`` only chooses between two ways to the same verdicts.
All frequent items of all labelled URLs are mined, and all URLs are matched, with
all their tokens.  Equal token sets are matched once, so a host with a third of the
rows costs a row a task.

Defined cases: a null URL or one without "://" has empty host and path, fits no
rule and is judged by its words; without labels every URL off the list is
``DEFAULT``; repeated rows give a row each; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import read, written

ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW

# Verdict, host, path prefix.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

MIN_SUPPORT = 0.002
MIN_ROWS = 10
MIN_CONFIDENCE = 0.6
MAX_ITEMS = 12

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LABEL = "label="  # no token begins so


# --- the rule list -----------------------------------------------------------

def _after_scheme() -> Column:
    return F.expr("substring(url, instr(url, '://') + 3)")


def _has_scheme() -> Column:
    return F.coalesce(F.instr(F.col("url"), "://") > 0, F.lit(False))


def host_of() -> Column:
    host = F.regexp_extract(_after_scheme(), r"^([^/?#]*)", 1)
    return F.when(_has_scheme(), F.translate(host, UPPER, LOWER)).otherwise("")


def path_of() -> Column:
    return F.when(_has_scheme(), F.regexp_extract(_after_scheme(), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def listed(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, or null."""
    out = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


# --- tokens ------------------------------------------------------------------

def tokens() -> Column:
    """The distinct tokens of ``url`` (with ``host`` and ``path``), sorted."""

    def words(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(_WORD), F.lit(0))
        return F.transform(found, lambda w: F.concat(
            F.lit(kind), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))

    url = F.coalesce("url", F.lit(""))
    rest = F.when(_has_scheme(), F.regexp_extract(_after_scheme(), r"^[^?#]*([\s\S]*)", 1)).otherwise(url)
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), words(F.col("path"), "p:"), words(rest, "q:"))))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens and label of the pages whose document is labelled."""
    marks = labels.select(F.col("doc_id").alias("_doc"), (F.coalesce((F.col("quality") == 0), F.lit(False))
                          | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_bad"),
                          (F.col("quality").isNotNull() | F.col("toxic").isNotNull()).alias("_known"))
    marks = marks.where("_known").groupBy("_doc").agg(F.max("_bad").alias("_bad"))
    number = F.regexp_extract("path", r"/([0-9]+)(?:[/.]|$)", 1).try_cast("long")
    shown = pages.withColumn("_doc", number).where(F.col("_doc").isNotNull())
    return shown.join(marks, "_doc").select("tokens", F.when(F.col("_bad"), BLOCK).otherwise(ALLOW).alias("label"))


# --- mining --------------------------------------------------------------------

def mine(rows: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS,
         min_confidence: float = MIN_CONFIDENCE, max_items: int = MAX_ITEMS) -> DataFrame:
    """Rules over ``rows`` (tokens, label): need (the tokens), key (the rarest of them),
    label, confidence and n (labelled URLs that hold it with that label)."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    n_rows = rows.count()
    if not n_rows:
        return rows.sparkSession.createDataFrame([], _RULE_SCHEMA)
    least = max(min_rows, -int(-min_support * n_rows // 1))
    each = rows.select("row", "label", F.explode("tokens").alias("token"))
    sign = F.xxhash64("row")
    stats = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == BLOCK).alias("bad"),
        F.sum(sign.cast("decimal(38,0)")).alias("sum"), F.bit_xor(sign).alias("xor")).where(F.col("n") >= least)
    # Tokens with the same rows are one item, named after the first of them.
    items = written(stats.groupBy("n", "bad", "sum", "xor").agg(
        F.array_sort(F.collect_list("token")).alias("members"))
        .select(F.col("members")[0].alias("item"), "members", "n"), "url-items")
    kept = each.join(items.select(F.col("item").alias("token"), F.struct("n", "item").alias("x")), "token")
    baskets = written(kept.groupBy("row", "label").agg(F.sort_array(F.collect_list("x"))["item"].alias("items")),
                      "url-baskets")
    # Support counts all labelled URLs, also those without a frequent token.
    size = baskets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("items")).alias("longest")).first()
    if not size.n:
        return rows.sparkSession.createDataFrame([], _RULE_SCHEMA)
    if size.longest > max_items:
        found = _grown(baskets, least, min_confidence)
    else:
        model = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0) / size.n, minConfidence=min_confidence).fit(
            baskets.select(F.array_append("items", F.concat(F.lit(_LABEL), "label")).alias("items")))
        found = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL)).select(
            F.array_sort("antecedent").alias("items"),
            F.substring(F.col("consequent")[0], len(_LABEL) + 1, 99).alias("label"),
            "confidence", F.round(F.col("support") * size.n).cast("long").alias("n"))
    found = written(found.where(F.col("n") >= least), "url-rules")
    return _spelled_out(_irredundant(found), items)


def _grown(baskets: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """The rules of ``baskets`` (items, rarest first, and label) that can decide a verdict,
    whatever the number of items: items, label, confidence and n.

    A combination is a rule of a label only if each of its items shuts out a URL of the
    other label (else it is as good without that item), and is left for the label when
    it lacks support, when an item shuts out none, or when no URL of the other label is
    left.  Longer combinations inherit each of the three."""
    # Combinations of a level, with the baskets that hold them: items that may still be added.
    open_ = written(baskets.groupBy(F.array().cast("array<string>").alias("items"), F.col("items").alias("more")).agg(
        F.count_if(F.col("label") == ALLOW).alias("allow"), F.count_if(F.col("label") == BLOCK).alias("block")), "url-open")
    before, rules = None, None
    while True:
        made = open_.withColumn("x", F.explode("more")).groupBy("items", "x").agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        made = made.where((F.col("allow") >= least) | (F.col("block") >= least)).select(
            F.col("items").alias("parent"), "x", F.array_append("items", F.col("x")).alias("items"), "allow", "block")
        enough = {ALLOW: F.col("allow") >= least, BLOCK: F.col("block") >= least}
        if before is not None:
            made = _shutting_out(made, before)
            enough = {k: v & F.col(f"for_{k}") for k, v in enough.items()}
        made = written(made.withColumns({f"for_{k}": v for k, v in enough.items()})
                       .where(F.col("for_allow") | F.col("for_block")), "url-made")
        for label in (ALLOW, BLOCK):
            new = made.where(f"for_{label}").select(
                "items", F.lit(label).alias("label"), (F.col(label) / (F.col("allow") + F.col("block"))).alias("confidence"),
                F.col(label).alias("n")).where(F.col("confidence") >= min_confidence)
            rules = new if rules is None else rules.unionByName(new)
        before = made.withColumns({"for_allow": F.col("for_allow") & (F.col("block") > 0),
                                   "for_block": F.col("for_block") & (F.col("allow") > 0)}).where("for_allow or for_block")
        if before.isEmpty():
            return rules
        # Only items that go on with the combination stay; equal baskets are one row.
        going = before.groupBy(F.col("parent").alias("items")).agg(F.collect_set("x").alias("going"))
        left = open_.join(going, "items").withColumn("more", F.array_intersect("more", "going"))
        open_ = written(left.select("items", "allow", "block", "more", F.posexplode("more").alias("i", "x")).select(
            F.array_append("items", F.col("x")).alias("items"),
            F.slice("more", F.col("i") + 2, F.greatest(F.size("more") - F.col("i") - 1, F.lit(0))).alias("more"),
            "allow", "block").where(F.size("more") > 0).groupBy("items", "more").agg(
                F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-open")


def _shutting_out(made: DataFrame, before: DataFrame) -> DataFrame:
    """``made`` with, for each label, whether all its combinations of one item less went
    on for the label and had more URLs of the other one."""
    less = made.withColumn("less", F.explode("items")).withColumn("less", F.array_remove("items", F.col("less")))
    was = before.select(F.col("items").alias("less"), F.col("allow").alias("allow0"), F.col("block").alias("block0"),
                        "for_allow", "for_block")
    keep = {"for_allow": F.col("for_allow") & (F.col("block") < F.col("block0")),
            "for_block": F.col("for_block") & (F.col("allow") < F.col("allow0"))}
    return less.join(was, "less", "left").groupBy("parent", "x", "items", "allow", "block").agg(
        *(F.min(F.coalesce(v, F.lit(False))).alias(k) for k, v in keep.items()))


_RULE_SCHEMA = "need array<string>, key string, label string, confidence double, n long"


def _irredundant(rules: DataFrame) -> DataFrame:
    """Rules without a rule of one item less that is as confident."""
    shorter = rules.where(F.size("items") > 1).select(
        "items", "label", "confidence", F.explode("items").alias("x")).select(
        F.col("items").alias("long"), "label", F.col("confidence").alias("own"),
        F.array_remove("items", F.col("x")).alias("items"))
    beaten = shorter.join(rules, ["items", "label"]).where(F.col("confidence") >= F.col("own"))
    return rules.join(beaten.select(F.col("long").alias("items"), "label").distinct(), ["items", "label"], "left_anti")


def _spelled_out(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Rules with all tokens of their items, filed under the rarest."""
    each = rules.withColumn("item", F.explode("items")).join(
        items.select("item", "members", F.col("n").alias("rows")), "item")
    return each.groupBy("items", "label", "confidence", "n").agg(
        F.array_sort(F.flatten(F.collect_list("members"))).alias("need"),
        F.min(F.struct("rows", "item"))["item"].alias("key")).select(
        "need", "key", "label", "confidence", "n")


# --- matching ------------------------------------------------------------------

def verdicts(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdict of the best rule that each token set (``tokens``, distinct) holds;
    sets that hold none are left out."""
    looked_up = sets.withColumn("key", F.explode("tokens")).join(rules, "key")
    held = looked_up.where(F.size(F.array_except("need", "tokens")) == 0)
    order = F.struct("confidence", "n", -F.size("need"), F.col("label") == BLOCK)
    return held.groupBy("tokens").agg(F.max(F.struct(order.alias("by"), "label"))["label"].alias("learned"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE,
          max_items: int = MAX_ITEMS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    base = pages.select("page_id", "url").withColumns({"host": host_of(), "path": path_of()})
    base = written(base.withColumns({"tokens": tokens(), "base": listed(rules)})
                   .drop("url"), "url-pages")
    learned = mine(labelled(base, labels), min_support, min_rows, min_confidence, max_items)
    open_ = base.where(F.col("base").isNull())
    found = verdicts(open_.select("tokens").distinct(), learned)
    out = open_.join(found, "tokens", "left").unionByName(
        base.where(F.col("base").isNotNull()).withColumn("learned", F.lit(None).cast("string")))
    return out.select("page_id", "host", "path", F.col("base")["rule"].alias("rule"),
                      F.coalesce(F.col("base")["verdict"], "learned", F.lit(DEFAULT)).alias("verdict"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
