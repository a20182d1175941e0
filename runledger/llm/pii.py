"""Personal data by bootstrapped contextual extraction.

1. One pass over the whole texts finds the base entities (e-mail, IP address,
   payment card, phone number) by rule.  They are the seeds.  Around them and
   around every other run of identifier-like tokens it notes the shape (digit
   runs with their lengths, letter runs as one letter) and the context: the
   neighbouring word, or the neighbour's shape, on either side.  A candidate of
   a kind need only have its loose form: a phone without "+", a card with any
   separator, an e-mail or IP address with "[at]", "dot" and the like.
2. Patterns are (shape, context) pairs, instances are the strings.  Words next
   to an identifier are patterns of their own, whatever its shape, so unseen
   shapes are reached; a word that goes with several kinds is not trusted.  Spark
   scores the bipartite graph in rounds: a pattern is trusted by the share of
   its instances that are known, damped for little support; an unseen instance
   by the patterns it stands in (noisy or).  Instances over the bar become
   known and count in the next round.
3. Unseen instances that are known in the end become spans, when they pass the
   kind's own check and overlap no base span.  Base spans always stay.

So a card number that follows a phone number, which the rules join into one
failing match, is found by its shape and what usually follows a card, and a
phone number without "+" by the words that usually stand before one.  What makes
a value is kept in any form: a card's check digit, an address's four bytes.

Defined cases: a null text is empty; repeated rows give a row each; a text
without identifiers has no spans; an empty table gives no row; other columns
are ignored.  Numbers of any length are handled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import TEXT_ROWS, batch_rows, carried, read, utf8, with_fields, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
PATTERN_BAR = 0.75      # least confidence of a pattern that counts
INSTANCE_BAR = 0.9      # least score of an instance that becomes known
SUPPORT = 5             # known instances that a pattern needs
MOST_DIGITS = 19        # digits that the rules allow in an identifier

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can start inside a run of digits; looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"\s|\Z")
_EDGE = ".,;:!?\"'"
# Loose forms: what a candidate of a kind must look like, beside its value.
_NUMBER = re.compile(r"[+(]*[0-9][0-9\x20()./_\u00B7\u2010-\u2015-]*")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./_])[0-9]{1,2}\1[0-9]{1,2}"
                   r"|[0-9]{1,2}([-./_])[0-9]{1,2}\2(?:19|20)[0-9]{2}")
_GAP = r"[\t\n\r\x20]"
_DOT = rf"(?:\.|{_GAP}?[\[({{<](?:dot|\.)[\])}}>]{_GAP}?|{_GAP}dot{_GAP})"
_AT_DOMAIN = (rf"(?:{_GAP}?[\[({{<](?:at|@)[\])}}>]{_GAP}?|{_GAP}?@{_GAP}?|{_GAP}at{_GAP})"
              rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_LOOSE_EMAIL = re.compile(_AT_DOMAIN, re.IGNORECASE)
_LOOSE_IP = re.compile(rf"(?<![0-9])[0-9]++(?:{_DOT}[0-9]++){{3}}", re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"{_DOT}\Z", re.IGNORECASE)
#: Texts without digits and "@" that may hold an e-mail address, for RE2.
_SPELLED = rf"[A-Za-z0-9._%+-]{_AT_DOMAIN}"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(
        p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
        for p in parts)


def is_card(s: str) -> bool:
    d = _digits(s)
    if not 16 <= len(d) <= 19:
        return False
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def is_phone(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, sorted."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for kind, rule, check in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in rule.finditer(text) if check(m.group())]
    return out


_DIGIT_RUN = re.compile(r"[0-9]+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")


def shape(s: str) -> str:
    return _DIGIT_RUN.sub(lambda m: f"9{{{len(m.group())}}}", _LETTER_RUN.sub("a", s))


def _key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)


def _neighbour(token: str) -> str:
    if not token:
        return "^"
    if _ANCHOR.search(token):
        return "<" + shape(token.strip(_EDGE))[:64] + ">"
    return token.strip(_EDGE).lower()[:64]


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    left = text[max(0, start - 80) : start].split()
    right = text[end : end + 80].lstrip(_EDGE).split()
    return _neighbour(left[-1] if left else ""), _neighbour(right[0] if right else "")


def _runs(text: str):
    """Runs of identifier-like tokens, parted by one space, as (start, end) lists."""
    run, at = [], 0
    m = _ANCHOR.search(text)
    while m:
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN_END.search(text, m.end()).start()
        if run and not (start == run[-1][1] + 1 and text[run[-1][1]] == " "):
            yield run
            run = []
        run.append((start, end))
        at = end
        m = _ANCHOR.search(text, at)
    if run:
        yield run


def _words(text: str, start: int, end: int) -> list[str]:
    """The words next to a place, and the pairs of words, by side."""
    left = [_neighbour(t) for t in text[max(0, start - 160) : start].split()[-2:]][::-1]
    right = [_neighbour(t) for t in text[end : end + 160].lstrip(_EDGE).split()[:2]]
    out = []
    for side, near in (("left", left), ("right", right)):
        if near and near[0] and near[0][0] != "<":
            out.append(f"{side} near {near[0]}")
            if len(near) > 1:
                out.append(f"{side} pair {near[0]} {near[1]}")
    return out


def _spelled_emails(text: str):
    """E-mail addresses by their loose form."""
    last = 0
    for m in _LOOSE_EMAIL.finditer(text):
        start = at = m.start()
        while True:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            dot = _DOT_BEFORE.search(text, max(last, start - 7), start)
            if start == at or not dot or dot.start() == last or text[dot.start() - 1] not in _LOCAL:
                break
            at = start = dot.start()
        if start < m.start():
            yield start, m.end()
        last = m.end()


def _could(s: str) -> int:
    """Kinds, as bits, that a string of digits and separators may be."""
    phone = is_phone(s) and (s[:1] == "+" or bool(_NUMBER.fullmatch(s)) and not _DATE.fullmatch(s))
    return 2 * is_ip(s) + 4 * is_card(s) + 8 * phone


def _candidates(text: str, base):
    """(could, start, end, whole) of strings beside the base spans.  A string of
    tokens has up to MOST_DIGITS digits; it is whole if no token could be added."""
    ends = []
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if ends and a <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    starts, ends = [a for a, _ in ends], [b for _, b in ends]

    def taken(start, end):
        k = bisect_left(starts, end)
        return k > 0 and ends[k - 1] > start

    for start, end in _spelled_emails(text):
        if not taken(start, end):
            yield 1, start, end, True
    for m in _LOOSE_IP.finditer(text):
        if not taken(*m.span()) and is_ip(".".join(_DIGIT_RUN.findall(m.group()))):
            yield 2, *m.span(), True
    for run in _runs(text):
        digits = [0 if taken(a, b) else sum("0" <= c <= "9" for c in text[a:b]) for a, b in run]
        for i in range(len(run)):
            n = 0
            for j in range(i, len(run)):
                n += digits[j]
                # each token that is joined has a digit, so a start has few ends
                if n > MOST_DIGITS or not digits[j]:
                    break
                if n < 4:
                    continue
                start, end = run[i][0], run[j][1]
                s = text[start:end]
                start += len(s) - len(s.lstrip(_EDGE))
                end -= len(s) - len(s.rstrip(_EDGE))
                s = text[start:end]
                # brackets around the whole, or one alone, are none of its own
                if s[:1] == "(" and s.find(")") in (-1, len(s) - 1):
                    start += 1
                if s[-1:] == ")" and s.rfind("(") in (-1, 0):
                    end -= 1
                could = _could(text[start:end])
                if could:
                    yield could, start, end, (
                        (i == 0 or not digits[i - 1]) and (j + 1 == len(run) or not digits[j + 1]))


_FOUND = "kind int, could int, start long, end long, value long, shape string, left string, " \
         "right string, words array<string>"
_SPAN = "kind int, start long, end long"
_FOUND_T = pa.struct([("kind", pa.int32()), ("could", pa.int32()), ("start", pa.int64()),
                      ("end", pa.int64()), ("value", pa.int64()), ("shape", pa.string()),
                      ("left", pa.string()), ("right", pa.string()), ("words", pa.list_(pa.string()))])
_SPAN_T = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _inspect(text: str):
    base = base_spans(text)
    found = []
    rows = [(kind, 0, a, b, True) for kind, a, b in base]
    rows += [(-1, *x) for x in _candidates(text, base)]
    for kind, could, a, b, whole in rows:
        s = text[a:b]
        left, right = _around(text, a, b)
        found.append({"kind": kind, "could": could, "start": a, "end": b, "value": _key(s),
                      "shape": shape(s)[:256], "left": left, "right": right,
                      "words": _words(text, a, b) if whole else []})
    return [{"kind": k, "start": a, "end": b} for k, a, b in base], found


def inspect(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``rec``, a row number, base spans, and seeds and candidates with their contexts."""
    marks = np.zeros(256, bool)
    marks[48:58] = marks[64] = True

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offsets = utf8(b.column(1))
            hit = np.searchsorted(np.flatnonzero(marks[data]), offsets)
            spelled_out = pc.match_substring_regex(b.column(1), _SPELLED, ignore_case=True)
            some = (hit[1:] > hit[:-1]) | spelled_out.fill_null(False).to_numpy(zero_copy_only=False)
            base, found = [], []
            for k in range(b.num_rows):
                x, y = _inspect(b.column(1)[k].as_py()) if some[k] else ([], [])
                base.append(x)
                found.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(row, row + b.num_rows)),
                 pa.array(base, pa.list_(_SPAN_T)), pa.array(found, pa.list_(_FOUND_T))],
                ["rec", "row", "base", "found"])
            row += b.num_rows

    out, rec = carried(docs, carry)
    return out.mapInArrow(run, with_fields(
        rec, f"row long, base array<struct<{_colons(_SPAN)}>>, "
             f"found array<struct<{_colons(_FOUND)}>>"))


def _colons(fields: str) -> str:
    return ",".join(x.strip().replace(" ", ":") for x in fields.split(","))


def _graph(seen: DataFrame) -> DataFrame:
    """Distinct edges (shape, context, value) with the seed kind, or null.

    A side's context is the neighbour itself and its class (word, identifier
    or edge of the text), with the shape; and its words, with any shape."""
    def kind_of(side):
        return F.when(F.col(side) == "^", "edge").when(F.col(side).startswith("<"), "identifier"
                                                       ).otherwise("word")
    contexts = F.array(
        F.concat(F.lit("left word "), "left"), F.concat(F.lit("right word "), "right"),
        F.concat(F.lit("left "), kind_of("left")), F.concat(F.lit("right "), kind_of("right")))
    pairs = F.concat(
        F.transform(contexts, lambda c: F.struct(F.col("shape").alias("shape"), c.alias("context"))),
        F.transform("words", lambda c: F.struct(F.lit("").alias("shape"), c.alias("context"))))
    return (seen.select("value", "could", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"),
                        F.explode(pairs).alias("p"))
            .select("p.shape", "p.context", "value", "could", "kind")
            .groupBy("shape", "context", "value")
            .agg(F.max("kind").alias("kind"), F.max("could").alias("could")))


def bootstrap(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind) of the unseen instances that become known."""
    edges = written(_graph(seen), "edges")
    known = None
    for _ in range(rounds):
        if known is None:
            e = edges.withColumn("as", F.col("kind"))
        else:
            e = edges.join(known.withColumnRenamed("kind", "learned"), "value", "left").withColumn(
                "as", F.coalesce("kind", "learned"))
        counts = [F.count_if(F.col("as") == k).alias(f"n{k}") for k in range(len(KINDS))]
        best = F.greatest(*(F.col(f"n{k}") for k in range(len(KINDS))))
        kind = reduce(lambda out, k: F.when(F.col(f"n{k}") == best, F.lit(k)).otherwise(out),
                      reversed(range(len(KINDS))), F.lit(None).cast("int"))
        patterns = (e.groupBy("shape", "context").agg(F.count(F.lit(1)).alias("n"), *counts)
                    .select("shape", "context", kind.alias("as"), best.alias("k"),
                            (best / F.col("n") * best / (best + 1)).alias("trust"))
                    .where((F.col("k") >= SUPPORT) & (F.col("trust") >= PATTERN_BAR)))
        scored = (edges.where(F.col("kind").isNull())
                  .join(patterns, ["shape", "context"])
                  .where(F.col("could").bitwiseAND(F.expr("shiftleft(1, as)")) != 0)
                  .groupBy("value", F.col("as").alias("kind"))
                  .agg(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))).alias("doubt")))
        known = written(scored.where(1 - F.exp("doubt") >= INSTANCE_BAR)
                        .groupBy("value").agg(F.min_by("kind", F.struct("doubt", "kind")).alias("kind")),
                        "known")
    return known


def find_spans(docs: DataFrame, rounds: int = ROUNDS, carry: list[str] | None = None) -> DataFrame:
    """``rec``, base and spans: arrays of struct<kind, start, end>, by kind and start.

    ``spans`` holds the base spans and the discovered ones."""
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        found = written(inspect(docs, carry), "inspected")
    seen = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    # a string that is a base entity elsewhere is known there; it is no new instance
    seeds = seen.where(F.col("kind") >= 0).groupBy("value").agg(F.min("kind").alias("kind"))
    known = bootstrap(seen, rounds).unionByName(
        seeds.select("value", "kind")).groupBy("value").agg(F.min("kind").alias("kind"))
    extra = (seen.where(F.col("kind") < 0).drop("kind").join(known, "value")
             .where(F.col("could").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0)
             .groupBy("row").agg(F.sort_array(F.collect_set(F.struct(
                 "start", (-F.col("end")).alias("stop"), "kind"))).alias("extra")))
    # of overlapping discoveries the earliest stays, of those the longest
    kept = F.aggregate(
        "extra", F.array().cast(f"array<struct<{_colons(_SPAN)}>>"),
        lambda out, x: F.when(
            F.coalesce(F.element_at(out, F.when(F.size(out) > 0, -1).otherwise(None))["end"], F.lit(0))
            <= x["start"],
            F.concat(out, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                           (-x["stop"]).alias("end"))))).otherwise(out))
    none = F.array().cast(f"array<struct<{_colons(_SPAN)}>>")
    # only rows with candidates meet the discoveries; the others are not shuffled
    some = F.exists("found", lambda x: x["kind"] < 0)
    base = F.array_sort("base").alias("base")
    return (found.where(~some).select("rec", base, F.array_sort("base").alias("spans"))
            .unionByName(found.where(some).join(extra, "row", "left").select(
                "rec", base, F.array_sort(F.concat("base", F.when(
                    F.col("extra").isNotNull(), kept).otherwise(none))).alias("spans"))))


def redact(found: DataFrame) -> DataFrame:
    """``rec`` with every span of its text replaced by ``<KIND>``; overlapping
    spans are replaced together, under the kind of the first."""

    def run(batches):
        for b in batches:
            rec = b.column(0)
            text = rec.field("text").to_pylist()
            for k, spans in enumerate(b.column(1).to_pylist()):
                if not spans:
                    continue
                out, at, t = [], 0, text[k]
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        out += [t[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                    at = max(at, s["end"])
                text[k] = "".join(out) + t[at:]
            names = [f.name for f in rec.type]
            columns = [pa.array(text, pa.string()) if n == "text" else rec.field(i)
                       for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.select("rec", "spans").mapInArrow(run, found.schema["rec"].dataType)


def spelled(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _count(spans: str, kind: int) -> F.Column:
    # Spark would pass the place in the array as a second argument, even one with a default
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op1_pii_bootstrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_spans(read(spark, sf_dir, "documents"), carry=["doc_id"])
    n = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("rec.doc_id", *n, F.sha2(spelled("base"), 256).alias("base_sha256"),
                      spelled("spans").alias("spans"))
