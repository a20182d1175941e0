"""Importance resampling towards a target distribution, without replacement.

1. Features are the runs of 1 to ``NGRAMS`` consecutive words, hashed into
   ``BUCKETS`` buckets.  Each task counts its buckets in one array; Spark adds the
   arrays up.  A bucket's gain compares its share in the target with its share in
   the documents.
2. A document's weight is the sum of the gains its features select from the array
   of gains, its score that weight plus a Gumbel draw from a hash of its id, so the
   highest scores are a weighted sample without replacement.
3. The cutoff is found without a sort of all scores, by weighted medians of
   medians.  Every task takes the medians of its batches of remaining keys and
   their median by remaining sizes; the driver sees one such median and three
   counts a task and takes their weighted median as the pivot.  At least an
   eighth of the remaining keys lie on either side of it, so each round discards a
   guaranteed share, until the pivot is the key sought.  When few remain they
   are written anew, so all rounds together read a small multiple of the keys.
4. Only the winners are sorted, by range, and ranked by the sizes of the ranges.

Bounds: the gains are ``BUCKETS`` numbers; the driver holds a few numbers for each
task.  No join and no group by document takes place.

Defined cases: null and empty texts have no features and weight 0; a null id
draws as the empty string and ranks last among equals; of rows equal in score and
id, as many are drawn as there is room for; an empty table gives no row, an empty
target leaves the documents' own distribution; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm import words
from runledger.llm.common import pieces, read, utf8, written

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: The remaining keys are written anew once they are this share of the table.
REWRITE = 1 / 8

#: The keys in the order of selection: high scores first, then small ids.
Key = tuple[int, int]
_LAST_ID = np.iinfo(np.int64).max


# --- buckets ---------------------------------------------------------------

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_LONG = 64  # longer words go one by one


def crc_extend(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each text so far, extended by ``data[starts[i]:ends[i]]``."""
    n = ends - starts
    state = crc ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(np.minimum(n, _LONG + 1).astype(np.uint8), kind="stable")[::-1]
    order = order[np.searchsorted(-n[order], -_LONG):]  # n falls along ``order``
    left, at, s = n[order], starts[order], state[order]
    for i in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -i))  # those longer than i
        s[:k] = _CRC[(s[:k] ^ data[at[:k] + i]) & 255] ^ (s[:k] >> 8)
    state[order] = s
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > _LONG):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(crc[i]))
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, ngrams: int, buckets: int):
    """Buckets of all features with their rows, and the words of each row."""
    low, starts, ends, row = words.split(data, offsets)
    n_words = np.diff(row)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    left = np.repeat(row[1:], n_words) - np.arange(len(starts))  # words from here to the end of the row
    crc = np.zeros(len(starts), np.uint32)
    space, found, rows = np.full(1, 32, np.uint8), [], []
    first = np.arange(len(starts))
    for k in range(ngrams):
        first = first[left[first] > k]
        if not len(first):
            break
        state = crc[first]
        if k:
            zero = np.zeros(len(first), np.int64)
            state = crc_extend(state, space, zero, zero + 1)
        crc[first] = crc_extend(state, low, starts[first + k], ends[first + k])
        found.append((crc[first] % np.uint32(buckets)).astype(np.int64))
        rows.append(row_of[first])
    empty = np.zeros(0, np.int64)
    return np.concatenate(found or [empty]), np.concatenate(rows or [empty]), n_words


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of column ``text`` fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in pieces(offsets):
                part = data[offsets[i]:offsets[j]]
                found, _, _ = feature_buckets(part, offsets[i:j + 1] - offsets[i], ngrams, buckets)
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths of a nat, rounded down."""
    s_all, t_all, b = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


# --- scores ----------------------------------------------------------------

def scores(docs: DataFrame, gain: np.ndarray, ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                found, rows, n_words = feature_buckets(
                    data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ngrams, buckets)
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, rows, gain[found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_words),
                     pa.array(np.bincount(rows, minlength=j - i)), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", F.col("weight") + gumbel)


# --- the cutoff --------------------------------------------------------------

def _less(a: np.ndarray, b: np.ndarray, key: Key) -> np.ndarray:
    return (a < key[0]) | ((a == key[0]) & (b < key[1]))


def _median(a: np.ndarray, b: np.ndarray) -> Key:
    """The lower median of the keys."""
    i = (len(a) - 1) // 2
    x = np.partition(a, i)[i]
    ties = np.sort(b[a == x])
    return int(x), int(ties[i - int((a < x).sum())])


def weighted_median(found: list[tuple[Key, int]]) -> Key:
    """The smallest key with half of the weight at or below it."""
    found = sorted(found)
    half, below = sum(n for _, n in found), 0
    for key, n in found:
        below += n
        if 2 * below >= half:
            return key
    raise ValueError("no keys")


def _sides(low: Key | None, pivot: Key | None, high: Key | None):
    """Per task: sizes of what lies below, at and above the pivot between the
    bounds, with the weighted median of the batches' medians on either side.
    Without a pivot all of it counts as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, medians = [0, 0, 0], ([], None, [])
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            keep = np.ones(len(a), bool)
            if low is not None:
                keep &= ~_less(a, b, low) & ~((a == low[0]) & (b == low[1]))
            if high is not None:
                keep &= _less(a, b, high)
            a, b = a[keep], b[keep]
            if pivot is None:
                below, same = np.zeros(len(a), bool), np.zeros(len(a), bool)
            else:
                below, same = _less(a, b, pivot), (a == pivot[0]) & (b == pivot[1])
            for side, here in ((0, below), (1, same), (2, ~below & ~same)):
                if n := int(here.sum()):
                    count[side] += n
                    if side != 1:
                        medians[side].append((_median(a[here], b[here]), n))
        m = [weighted_median(x) if x else (None, None) for x in (medians[0], medians[2])]
        yield pa.RecordBatch.from_pydict(
            {k: pa.array([v], pa.int64()) for k, v in zip(_SIDES, (*count, *m[0], *m[1]))})

    return run


_SIDES = ("n_below", "n_same", "n_above", "below_a", "below_b", "above_a", "above_b")


def cutoff(keys: DataFrame, rank: int, rewrite: float = REWRITE) -> Key:
    """The key with ``rank`` (from 1) of the table ``keys`` (a, b: long, ascending)."""
    low = high = pivot = None
    remaining = stored = 0
    while True:
        found = keys.select("a", "b").mapInArrow(
            _sides(low, pivot, high), ", ".join(f"{c} long" for c in _SIDES)).collect()  # one row a task
        below, same, above = (sum(r[c] for r in found) for c in _SIDES[:3])
        if pivot is None:
            side, remaining, stored = "above", above, above
        elif rank <= below:
            side, remaining, high = "below", below, pivot
        elif rank <= below + same:
            return pivot
        else:
            side, remaining, low, rank = "above", above, pivot, rank - below - same
        if not 1 <= rank <= remaining:
            raise ValueError("rank is beyond the keys")
        pivot = weighted_median([((r[f"{side}_a"], r[f"{side}_b"]), r[f"n_{side}"])
                                 for r in found if r[f"n_{side}"]])
        if remaining < rewrite * stored:
            keys, stored = written(_between(keys, low, high), "resampling-keys"), remaining


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    if low is not None:
        keys = keys.where((F.col("a") > low[0]) | ((F.col("a") == low[0]) & (F.col("b") > low[1])))
    if high is not None:
        keys = keys.where((F.col("a") < high[0]) | ((F.col("a") == high[0]) & (F.col("b") < high[1])))
    return keys


# --- the sample --------------------------------------------------------------

def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` (from 1) by ``order``: a range sort, and for each range the
    number of rows before it."""
    at = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "resampling-sorted")
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range of the sort.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    within = F.col("_at") - F.shiftleft("_part", 33)
    return out.withColumn("rank", F.col("_before") + within + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with n_words, n_features, weight, score and its rank in the
    sample of ``percent`` percent of the documents of at least ``min_words`` words."""
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    a, b = -F.col("score"), F.coalesce("doc_id", F.lit(int(_LAST_ID)))
    all_ = written(scores(docs, gain, ngrams, seed).withColumns({"a": a, "b": b}), "resampling-scores")
    able = F.col("n_words") >= min_words
    size = all_.where(able).count() * percent // 100
    if not size:
        return all_.drop("a", "b").withColumn("rank", F.lit(None).cast("long"))
    key = cutoff(all_.where(able).select("a", "b"), size)
    first = able & ((F.col("a") < key[0]) | ((F.col("a") == key[0]) & (F.col("b") <= key[1])))
    # Rows equal in the key are told apart by their place, so that no range is one key.
    won = all_.where(first).withColumn("_row", F.monotonically_increasing_id())
    won = ranked(won, "a", "b", F.col("doc_id").asc_nulls_last(), "_row").drop("_row")
    won = won.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    rest = all_.where(~first).withColumn("rank", F.lit(None).cast("long"))
    return won.unionByName(rest).drop("a", "b")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_HEX_SQL = "(instr('0123456789ABCDEF', substr({x}, {i}, 1)) - 1)"
ORACLE = f"""
with recursive steps as (
  select i::bigint as i, i::bigint as c, 0 as k from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k + 1 from steps where k < 8),
crc_table as (select list(c order by i) as t from steps where k = 8),
d as (select row_number() over () as r, doc_id, coalesce({_WORDS_SQL}, []) as w from documents),
b as (select coalesce({_WORDS_SQL}, []) as w from benchmark),
dw as (select r, unnest(w) as x from d),
bw as (select unnest(w) as x from b),
hexes as (select x, hex(encode(x)) as hx from (select x from dw union select x from bw)),
byte_lists as (
  select x, list_transform(range(1, length(hx) + 1, 2),
    lambda i: (16 * {_HEX_SQL.format(x='hx', i='i')} + {_HEX_SQL.format(x='hx', i='i + 1')})::bigint) as bytes
  from hexes),
vocab as (
  select x, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::bigint) % {BUCKETS} as bucket
  from byte_lists, crc_table),
s as (select bucket, count(*) as n from dw join vocab using (x) group by bucket),
t as (select bucket, count(*) as n from bw join vocab using (x) group by bucket),
totals as (select (select count(*) from dw)::double as s_all, (select count(*) from bw)::double as t_all),
gain as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * (s_all + {BUCKETS})
                                 / ((s.n::double + 1) * (t_all + {BUCKETS}))))::bigint as g
  from s left join t using (bucket), totals),
weights as (select r, sum(g)::bigint as weight from dw join vocab using (x) join gain using (bucket) group by r),
h as (select r, doc_id, len(w) as n, coalesce(weight, 0)::bigint as weight,
             upper(substr(sha256('{SEED}:' || doc_id), 1, 8)) as hx
      from d left join weights using (r)),
scored as (
  select doc_id, n, weight, weight + floor(-1000 * ln(-ln((
    {' + '.join(f"{16 ** (8 - i)} * {_HEX_SQL.format(x='hx', i=i)}" for i in range(1, 9))}
    + 0.5::double) / 4294967296::double)))::bigint as score from h),
able as (select *, row_number() over (order by score desc, doc_id) as k, count(*) over () as n_able
         from scored where n >= {MIN_WORDS}),
drawn as (select doc_id, k from able where k <= {PERCENT} * n_able // 100)
select s.doc_id, s.n::bigint as n_features, s.weight, s.score, drawn.k::bigint as rank
from scored s left join drawn using (doc_id)
"""
