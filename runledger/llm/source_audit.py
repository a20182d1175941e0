"""How far the sources of each language diverge in their use of words.

1. A shard (a piece of an Arrow batch, its documents ordered by language and
   source) is one buffer of lower-cased bytes with a pointer to the start of every
   term.  The pointers are sorted by multikey quicksort with slices of eight bytes
   as its characters: all pointers by their first slice, then only the runs that
   are still equal and longer by their next one.  The sort is stable, so inside a
   run of equal terms the pointers stand in the order of documents: changes of
   document give the document frequency, changes of source the source counts.
2. Spark adds the shards' (language, source, term) cells up, keeps the terms of
   enough documents of the language, and computes shares in exact integers.
3. Top terms: a windowed rank, of which Spark applies the limit before it shuffles.
4. Pairs of sources: kept terms are dealt into shards of at most about ``CELLS``
   (source, term) cells, and a shard gives one partial sum for each pair.  Beyond
   ``BLOCK`` sources of a language each shard is split by blocks of sources.

No text is shuffled; a cell leaves a shard once, however often its term stands
there, so a common word or a source with a third of the rows costs a row a shard.

Defined cases: null text, language and source read as ''; a group without terms
has its pairs and no term; a language without kept terms has pairs of value 0;
repeated rows are documents of their own; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm import words
from runledger.llm.common import pieces, read, utf8, written

MIN_DOCS = 30
TOP = 50
PRIOR = 5
SCALE = 1_000_000_000
SHARD_BYTES = 1 << 21  # the arrays of a shard take some 30 times as much
CELLS = 1 << 16
BLOCK = 512

#: Terms hold no digits: for the word splitter these bytes are blanks.
_NO_DIGITS = np.arange(256, dtype=np.uint8)
_NO_DIGITS[48:58] = 32

_KEEP = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * r)) & 0xFFFFFFFFFFFFFFFF for r in range(1, 9)], np.uint64)


# --- counting in a shard ---------------------------------------------------

def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the terms ``data[starts[i]:ends[i]]`` (equal ones by place), and
    which places of that order begin a run of equal terms.  Terms hold no zero byte."""
    n = len(starts)
    order, first = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, first
    first[0] = True
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    slices = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))  # eight bytes from each place
    open_, depth = np.arange(n), 0
    while len(open_):
        ptr = order[open_]
        at = starts[ptr] + depth
        left = np.clip(ends[ptr] - at, 0, 8)
        key = slices[np.minimum(at, len(data))].astype(np.uint64) & _KEEP[left]
        run = np.cumsum(first)[open_]
        by = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, run))
        order[open_], key = ptr[by], key[by]
        new = np.ones(len(open_), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        first[open_] |= new
        # Runs of several pointers whose slice was full go on.
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        more = np.repeat(size > 1, size) & ((key & np.uint64(255)) != 0)
        open_, depth = open_[more], depth + 8
    return order, first


def cells(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """Terms of the rows ``data[offsets[i]:offsets[i + 1]]``, whose groups rise: for each
    (group, term) the group, place and length of the term in the lower-cased bytes,
    occurrences and rows."""
    low, starts, ends, row = words.split(_NO_DIGITS[data], offsets)
    order, first = sort_pointers(low, starts, ends)
    doc = np.repeat(np.arange(len(group)), np.diff(row))[order]
    new_doc, new_cell = first.copy(), first.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    new_cell[1:] |= group[doc[1:]] != group[doc[:-1]]
    at = np.flatnonzero(new_cell)
    n = np.diff(np.append(at, len(order)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else n
    ptr = order[at]
    return low, group[doc[at]], starts[ptr], ends[ptr] - starts[ptr], n, docs


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(starts),
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[take])])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Order the documents by group, then read them as one buffer.
        table = pa.Table.from_batches([batch]).sort_by([("lang", "ascending"), ("source", "ascending")])
        lang, source = (table[c].combine_chunks() for c in ("lang", "source"))
        change = np.zeros(len(table), bool)
        for c in (lang, source):
            change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(change)
        heads = np.concatenate(([0], np.flatnonzero(change))) if len(table) else np.zeros(0, np.int64)
        zero = np.zeros(len(heads), np.int64)
        yield _cells_batch(lang.take(pa.array(heads)), source.take(pa.array(heads)),
                           pa.array([""] * len(heads), pa.string()), zero, zero)
        data, offsets = utf8(table["text"])
        for i, j in pieces(offsets, SHARD_BYTES):
            low, g, start, length, n, docs = cells(
                data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], group[i:j])
            for a, b in pieces(np.concatenate(([0], np.cumsum(length + 64)))):
                head = pa.array(heads[g[a:b]])
                yield _cells_batch(lang.take(head), source.take(head),
                                   _strings(low, start[a:b], length[a:b]).cast(pa.string()), n[a:b], docs[a:b])


def _cells_batch(lang, source, term, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(docs)],
                                      ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term in each (lang, source); the row with
    the empty term stands for the group itself."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares ------------------------------------------------------------------

def share(n: str, total: str) -> F.Column:
    """1 + floor(SCALE * (n + PRIOR) / total), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + {PRIOR} as decimal(19, 0))) div {total}")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same on arrays: long division by three digits at a time stays in 64 bits."""
    q, r = np.divmod(n + PRIOR, total)
    for _ in range(3):
        d, r = np.divmod(r * 1000, total)
        q = q * 1000 + d
    return 1 + q


def _pair_sums(key, kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial divergences of one shard of terms: sources of the block against all."""
    names = groups["source"].combine_chunks()
    total = groups["total"].to_numpy()
    mine = np.flatnonzero(groups["mine"].to_numpy(zero_copy_only=False))
    term = kept["term"].combine_chunks().dictionary_encode()
    n_terms = len(term.dictionary)
    count = np.zeros((n_terms, len(names)), np.int64)
    at = pc.index_in(kept["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    count[term.indices.to_numpy(zero_copy_only=False), at.astype(np.int64)] = kept["n"].to_numpy()
    p = shares(count, np.maximum(total, 1)[None, :]) if n_terms else count
    value = np.concatenate([np.abs(p - p[:, [a]]).sum(axis=0) for a in mine] or [np.zeros(0, np.int64)])
    a, b = np.repeat(mine, len(names)), np.tile(np.arange(len(names)), len(mine))
    other = a != b
    return pa.table({"lang": pa.array([key[0].as_py()] * int(other.sum()), pa.string()),
                     "source": names.take(pa.array(a[other])), "item": names.take(pa.array(b[other])),
                     "value": pa.array(value[other], pa.int64())})


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, n_cells: int = CELLS,
                block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` holds the divergence of each
    source from every other one of its language, part ``term`` the terms that it uses
    most beyond the language's share."""
    counts = written(term_counts(docs), "audit-counts")
    terms = counts.where(F.col("term") != "")
    by_lang = written(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                      .where(F.col("docs") >= min_docs).drop("docs"), "audit-terms")
    kept = written(terms.drop("docs").join(by_lang, ["lang", "term"]), "audit-kept")

    groups = counts.where(F.col("term") == "").select("lang", "source")
    langs = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(langs, "lang", "left").select(
        "lang", "n_sources", F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("lang_total", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = written(groups.join(sizes, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", "lang_total", (F.coalesce("n", F.lit(0)) + PRIOR * F.col("v")).alias("total"),
        F.greatest(F.ceil(F.col("v") * F.col("n_sources") / n_cells), F.lit(1)).cast("long").alias("shards"),
        F.ceil(F.col("n_sources") / block).cast("long").alias("blocks")), "audit-groups")

    p, q = share("n", "total"), share("lang_n", "lang_total")
    used = kept.join(groups, ["lang", "source"])
    over = used.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where(F.col("value") > 0)
    return _rank(over, "term").where(F.col("rank") <= top).unionByName(
        _rank(_pairs(used, groups), "pair"))


def _pairs(used: DataFrame, groups: DataFrame) -> DataFrame:
    dealt = used.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "shards").alias("shard"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    sides = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select(
        "lang", "source", "total", "shard", F.pmod(F.xxhash64("source"), "blocks").alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    sides = sides.select("lang", "source", "total", "shard", "block", (F.col("own") == F.col("block")).alias("mine"))
    key = ["lang", "shard", "block"]
    sums = dealt.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _rank(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                       F.row_number().over(w).alias("rank"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read(spark, sf_dir, "documents"))


ORACLE = rf"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
x as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from x group by lang, term having count(distinct r) >= {MIN_DOCS}),
c as (select lang, source, term, count(*) as n from x group by all),
gk as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n
       from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
t as (select *, sum(n) over (partition by lang, source) + {PRIOR} * count(*) over (partition by lang, source) as total,
        sum(lang_n) over (partition by lang, source) + {PRIOR} * count(*) over (partition by lang, source) as lang_total
      from gk),
p as (select lang, source, term, n,
        (1 + ({SCALE}::hugeint * (n + {PRIOR})) // total::hugeint)::bigint as p,
        (1 + ({SCALE}::hugeint * (lang_n + {PRIOR})) // lang_total::hugeint)::bigint as q from t),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as other, sum(abs(a.p - b.p)) as f
             from p a join p b on a.lang = b.lang and a.term = b.term group by all) s
    on s.lang = a.lang and s.source = a.source and s.other = b.source),
every as (select * from pairs union all
  select lang, source, 'term', term, p - q from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
select lang, source, part, item, value, rank::integer as rank from ranked where part = 'pair' or rank <= {TOP}
"""
