"""License scan by a positional index of rare words: DataFrame expressions only.

1. Document frequencies of the license vocabulary are counted over all texts.
2. Each template is filed under the ``KEYS`` words of highest IDF in its mandatory
   key phrase, with their positions.  A file is looked up by the license words it holds; every hit
   gives a start (position in the file less position in the template), and the
   starts of a template's words are intersected.
3. At the starts that are left, the mandatory key phrase must stand word by
   word at its place.  The score is the IDF share of the template's words that
   stand at theirs; wording outside the key phrase changes nothing else.

The vocabulary and the templates are fixed and small, so their frequencies are
a bounded result; texts are never shuffled.  A base phrase is a template of its
own whose key phrase is all of it: every place where its words stand is found.

Defined cases: null and empty texts have no words and no labels; repeated rows
give a row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEYS = 2

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, wording, mandatory key phrase.
TEMPLATES = (
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2",
     "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3",
     "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     "permission is hereby granted free of charge"),
    ("mit-name", "released under the mit license", "the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify"),
    ("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "released into the public domain", "into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    base: bool


def _template(label: str, text: str, key: str, base: bool) -> Template:
    w, k = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
    return Template(label, w, at, k, base)


def templates() -> list[Template]:
    return ([_template(label, phrase, phrase, True) for phrase, label in BASE]
            + [_template(*t, False) for t in TEMPLATES])


def words(text: str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _array(items) -> Column:
    return F.array(*(F.lit(x) for x in items))


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the vocabulary's words over all documents (one row per word)."""
    held = docs.select(F.array_intersect(words("text"), _array(vocabulary)).alias("w"))
    rows = (held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("idf", F.log((F.lit(float(1 << 40))) / F.col("n"))).collect())
    idf = {r["w"]: r["idf"] for r in rows}
    return {w: idf.get(w, 64.0) for w in vocabulary}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, matches array<struct<label, start, base, score>>."""
    known = templates()
    idf = rarity(docs, sorted({w for t in known for w in t.words}))
    filed = {t: sorted(range(t.key_at, t.key_at + len(t.key)),
                       key=lambda i, t=t: (-idf[t.words[i]], i))[: 1 if t.base else KEYS]
             for t in known}
    index = sorted({t.words[i] for t, at in filed.items() for i in at})

    # where the index words stand, in the files that hold any
    spotted = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: x["w"].isin(index))
    empty = F.array().cast("array<struct<w:string,i:int>>")
    d = docs.select("doc_id", words("text").alias("words"))
    d = d.withColumn("spots", F.when(F.arrays_overlap("words", _array(index)), spotted
                                     ).otherwise(empty))

    def starts(t: Template, i: int) -> Column:
        return F.transform(F.filter("spots", lambda x: x["w"] == t.words[i]), lambda x: x["i"] - i)

    def matches(t: Template) -> Column:
        agreed = reduce(F.array_intersect, [starts(t, i) for i in filed[t]])
        total = sum(idf[w] for w in t.words)
        held = F.filter(agreed, lambda s: F.when(
            s + t.key_at >= 0,
            F.slice("words", s + t.key_at + 1, len(t.key)) == _array(t.key)).otherwise(False))

        def share(s):
            found = F.lit(0.0)
            for i, w in enumerate(t.words):
                at = F.when(s + i >= 0, F.get("words", s + i))
                found = found + F.when(at == w, F.lit(idf[w] / total)).otherwise(F.lit(0.0))
            return F.least(found, F.lit(1.0))

        return F.transform(held, lambda s: F.struct(
            F.lit(t.label).alias("label"), s.alias("start"), F.lit(t.base).alias("base"),
            (F.lit(1.0) if t.base else share(s)).alias("score")))

    none = F.array().cast("array<struct<label:string,start:int,base:boolean,score:double>>")
    return d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(F.size("spots") > 0, F.concat(*(matches(t) for t in known))).otherwise(none)
        .alias("matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scan(read(spark, sf_dir, "documents"))

    def labels(of) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")

    m = m.withColumn("at", F.filter("matches", lambda x: x["base"]))
    starts = F.transform("at", lambda x: x["start"].cast("long"))
    return m.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("at").alias("base_labels"), labels("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0))
        .alias("score"))
