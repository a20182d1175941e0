"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``size`` consecutive words (a shorter item is one
window).  A document holds a window only if it holds each of its words, so by
the prefix principle one word is enough to look for: the window's rarest one,
by document frequencies counted over the whole corpus.  Documents are joined on
that word alone; a hit fixes where the window would have to start, which the
length and positional bounds check against the document's ends; then the words
are compared one by one at their exact places.

The windows are the query side.  They come in blocks whose text is bounded by
``block_bytes`` (one longer item is a block of its own) and are held as arrays of
word hashes, places and owners, about ten bytes for each byte of text.  Only one block
is on the driver and in a plan at a time: what it marks is written before the next
one is read.  Documents are never shuffled.

Defined cases: null, empty and wordless texts have no words and no hits; an
item without words has no window; items with one id and several rows count
once; a null item_id marks words but is not listed; repeated documents give a
row each; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import words
from runledger.llm.common import carried, pieces, read, sha256_of_list, utf8, with_fields, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20          # bytes of text worked on together
_TABLE_BITS = 20


class Lookup:
    """Places of a sorted set of hashes, behind a table of their low bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.mask = np.uint64(len(self.table) - 1)
        self.table[keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a key, and the keys' numbers."""
        at = np.flatnonzero(self.table[h & self.mask])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]


class Windows:
    """The windows of a block of items, filed under their rarest word."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        raw = [(text or "").encode() for _, text in items]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        self.low, self.starts, self.ends, row = words.split(np.frombuffer(b"".join(raw), np.uint8), bounds)
        self.h = words.hashes(self.low, self.starts, self.ends)
        n = np.diff(row)
        many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(n)), many)
        begin = np.repeat(row[:-1], many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(n, size)[item]
        self.size = int(length.max(initial=0))
        keys, number = np.unique(self.h, return_inverse=True)
        self.words, self.number = Lookup(keys), number
        begin, length, owner = self._merged(begin, length)
        self.begin, self.length = begin, length
        named = [k for k, (x, _) in enumerate(items) if x is not None]
        self.names = [x for x, _ in items]
        # (window, item) pairs, one of each, in the order of windows
        pair = np.unique(np.stack([owner, item], axis=1)[np.isin(item, named)], axis=0)
        self.items = pair[:, 1]
        self.items_from = np.searchsorted(pair[:, 0], np.arange(len(begin) + 1))

    def _merged(self, begin, length):
        """Equal windows as one: their places and lengths, and each window's number."""
        digest = length.astype(np.uint64)
        for o in range(self.size):
            inside = o < length
            digest[inside] = words.mix(digest[inside] ^ self.h[begin[inside] + o])
        _, first, owner = np.unique(digest, return_index=True, return_inverse=True)
        same = length == length[first[owner]]
        for o in range(self.size):       # a digest that stands for two windows parts them
            inside = np.flatnonzero(same & (o < length))
            same[inside] = self.h[begin[inside] + o] == self.h[begin[first[owner[inside]]] + o]
        other = np.flatnonzero(~same)
        owner[other] = len(first) + np.arange(len(other))
        keep = np.concatenate((first, other))
        return begin[keep], length[keep], owner

    def owners(self, window: int) -> list[str]:
        return [self.names[k] for k in self.items[self.items_from[window]:self.items_from[window + 1]].tolist()]

    def file(self, frequency: dict[int, int]) -> None:
        """Set each window's prefix word; ``frequency`` is by word number."""
        in_docs = np.zeros(len(self.words.keys), np.int64)
        in_docs[list(frequency)] = list(frequency.values())
        least = np.full(len(self.begin), np.iinfo(np.int64).max)
        key, offset = np.zeros(len(self.begin), np.int64), np.zeros(len(self.begin), np.int64)
        for o in range(self.size):
            inside = np.flatnonzero(o < self.length)
            word = self.number[self.begin[inside] + o]
            rarer = in_docs[word] < least[inside]
            at = inside[rarer]
            least[at], key[at], offset[at] = in_docs[word[rarer]], word[rarer], o
        self.order = np.argsort(key, kind="stable")
        self.offset = offset[self.order]
        used = np.unique(key)
        self.first = np.searchsorted(key[self.order], used)
        self.last = np.searchsorted(key[self.order], used, "right")
        self.prefix = Lookup(self.words.keys[used])

    def find(self, low, starts, ends, row, h):
        """(word position, window number) of every occurrence of a window."""
        at, k = self.prefix.find(h)
        if not len(at):
            return at, at
        many = self.last[k] - self.first[k]
        at = np.repeat(at, many)
        slot = np.repeat(self.last[k] - np.cumsum(many), many) + np.arange(len(at))
        window = self.order[slot]
        begin = at - self.offset[slot]
        # length and positional bounds: the window lies within one document
        doc = np.searchsorted(row, at, "right") - 1
        fits = (begin >= row[doc]) & (begin + self.length[window] <= row[doc + 1])
        begin, window = begin[fits], window[fits]
        for o in range(self.size):
            inside = o < self.length[window]
            there = np.minimum(begin + o, len(h) - 1)
            here = np.minimum(self.begin[window] + o, len(self.h) - 1)
            same = ~inside | (h[there] == self.h[here])
            begin, window = begin[same], window[same]
        exact = [all(low[starts[b + o]:ends[b + o]].tobytes() == self.low[self.starts[w + o]:self.ends[w + o]].tobytes()
                     for o in range(n))
                 for b, w, n in zip(begin.tolist(), self.begin[window].tolist(), self.length[window].tolist())]
        return begin[exact], window[exact]


def _frequencies(docs: DataFrame, block: Windows) -> dict[int, int]:
    """In how many documents each word of the block stands.  The result is as
    long as the block's vocabulary."""
    lookup = block.words

    def run(batches):
        total = np.zeros(len(lookup.keys), np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for i, j in pieces(offsets, PIECE):
                o = offsets[i : j + 1] - offsets[i]
                low, s, e, row = words.split(data[offsets[i] : offsets[j]], o)
                at, k = lookup.find(words.hashes(low, s, e))
                doc = np.searchsorted(row, at, "right") - 1
                seen = np.unique(doc * len(total) + k)
                total += np.bincount(seen % len(total), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, n long")
    return {r["word"]: r["n"] for r in
            counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"first": a, "end": b} for a, b in out]


_STATE = "text string, n_words long, spans array<struct<first:long,end:long>>, " \
         "items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _mark(docs: DataFrame, block: Windows) -> DataFrame:
    """Add the occurrences of a block's windows to ``spans`` and ``items``."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            n_words = np.zeros(len(offsets) - 1, np.int64)
            spans, items = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, j in pieces(offsets, PIECE):
                o = offsets[i : j + 1] - offsets[i]
                low, s, e, row = words.split(data[offsets[i] : offsets[j]], o)
                n_words[i:j] = np.diff(row)
                begin, window = block.find(low, s, e, row, words.hashes(low, s, e))
                doc = np.searchsorted(row, begin, "right") - 1
                found = defaultdict(list)
                for d, a, w in zip(doc.tolist(), begin.tolist(), window.tolist()):
                    found[d].append((a - int(row[d]), w))
                for d, hits in found.items():
                    old = [(x["first"], x["end"]) for x in spans[i + d]]
                    spans[i + d] = _merge(old + [(a, a + int(block.length[w])) for a, w in hits])
                    items[i + d] = sorted({*items[i + d], *(x for _, w in hits
                                                            for x in block.owners(w))})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words), pa.array(spans, _SPANS),
                 pa.array(items, pa.list_(pa.string()))],
                ["rec", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, with_fields(docs.schema["rec"], _STATE))


def blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[Windows]:
    """The items in blocks of bounded text, each read when the one before is done."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = benchmark.where(dealt == k).select(
            F.col("item_id").cast("string"), "text").collect()   # at most about block_bytes
        yield Windows([(r[0], r[1]) for r in rows], size)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
         block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Every document (``rec``) with n_words, the word ranges that windows cover
    (merged) and the item_ids found (as sorted strings)."""
    out, _ = carried(docs, carry)
    out = out.select("rec", "text", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<first:long,end:long>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    marked = False
    for block in blocks(benchmark, size, block_bytes):
        if marked:                       # only the last block's marks are still a plan
            out = written(out, "marked")
        block.file(_frequencies(docs, block))
        out, marked = _mark(out, block), True
    return out.drop("text")


def n_hit(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
                 carry=["doc_id"])
    return found.select(
        "rec.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        sha256_of_list("items").alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (
  select distinct item_id, array_to_string(w[i:i + 9], ' ') as x, least(len(w), 10) as k
  from (select *, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
grams as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as x
  from (select d.*, k, unnest(range(1, len(w) - k + 2)) as i
        from d, (select distinct k from win) where len(w) >= k)),
found as (select r, i, g.k, item_id from grams g join win using (x) where g.k = win.k),
hit as (
  select r, count(distinct p) as n
  from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from found)) group by r),
its as (
  select r, count(*) as n, string_agg(s, ',' order by s) as s
  from (select distinct r, cast(item_id as varchar) as s from found) group by r)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit,
  coalesce(its.n, 0)::bigint as n_items, sha256(coalesce(its.s, '')) as items_sha256,
  hit.n is not null as contaminated
from d left join hit using (r) left join its using (r)
"""
