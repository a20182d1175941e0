"""Removal of repeated 50-byte strings by blockwise suffix sorting.

A byte of a document goes if some string of ``LENGTH`` bytes that covers it also
starts in a document with a smaller doc_id.  That takes the classes of equal
``LENGTH``-byte suffix prefixes ("windows") over all documents:

1. Documents are written once as chunks of about ``CHUNK`` bytes.
2. Every window has an anchor, its smallest hashed 16-gram (leftmost at ties).
   Equal windows have equal anchors at equal places, so anchors deal suffixes
   into buckets.  Only anchors that stand in two documents or more can hold a
   repeat; the others are dropped before any text moves.
3. Runs of windows with one anchor are sent, each distinct run of a chunk once
   with its smallest doc_id, to the anchor's bucket.  Buckets are sorted one at
   a time: first the samples at a difference cover of the residues modulo
   ``MODULUS`` get ranks by their next 44 bytes; a window is then the rank of a
   sample at most 6 bytes in, and the 6 bytes the sample leaves out.  Long ties
   are settled by the samples' ranks, so no suffix is compared to its end and
   the memory of a bucket stays bounded.  (Runs are laid out with their anchors
   on one residue, so equal windows always share the first shift of the cover.)
4. Each class's smallest doc_id goes back to the chunks as one bit per window.

Sorting is by 64-bit digests of fixed-length words, and every tie is checked on
the words themselves; on a collision the words are sorted instead.

Defined cases: a null text is empty; a null doc_id counts as larger than all
others; rows with one doc_id are no repeats of each other; texts under 50 bytes
stay whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import pieces, read, utf8, written
from runledger.llm.words import mix

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1         # places of a gram in a window
MODULUS = 7
COVER = (0, 1, 3)                # their differences are all residues modulo 7
SAMPLE = LENGTH - MODULUS + 1    # bytes that a sample's rank stands for
CHUNK = 2 << 20
SEGMENT = 1 << 22                # windows whose anchors are found in one go
BUCKET = 4 << 20                 # bytes of text per bucket, about
_PLACE = np.uint64((1 << 24) - 1)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_LAST = np.iinfo(np.int64).max


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).copy()


def _gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _A + y * _B)


def anchors(data: np.ndarray) -> np.ndarray:
    """Place of the anchor of the window that starts at each place."""
    n = len(data) - LENGTH + 1
    out = np.zeros(max(n, 0), np.int64)
    for at in range(0, max(n, 0), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        x = words8(part)
        v = (_gram(x[:-8], x[8:]) & ~_PLACE) | np.arange(len(x) - 8, dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if width < SPAN:
            v = np.minimum(v[: len(v) - (SPAN - width)], v[SPAN - width :])
        out[at : at + len(v)] = (v & _PLACE).astype(np.int64) + at
    return out


class Runs:
    """The runs of windows with one anchor in a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        many = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        start = np.arange(total) + np.repeat(offsets[:-1] - (ends - many), many)
        a = anchors(data)[start]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        self.data = data
        self.begin = start[first]                               # first window
        self.count = np.diff(np.append(first, total))           # windows
        self.anchor = a[first]
        self.doc = np.searchsorted(offsets, self.begin, "right") - 1
        if total:
            x = words8(data)
            self.hash = _gram(x[self.anchor], x[self.anchor + 8])
        else:
            self.hash = np.zeros(0, np.uint64)

    def tags(self, buckets: int):
        """Distinct (bucket, tag) keys of the anchors, sorted; for each run its
        key's number; for each key whether two documents hold it."""
        key = ((self.hash >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) \
            | (self.hash & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.flatnonzero(np.diff(s, prepend=~s[:1]) != 0) if len(s) else np.zeros(0, np.int64)
        number = np.empty(len(key), np.int64)
        number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(s))))
        doc = self.doc[order]
        if not len(new):
            return s, number, np.zeros(0, bool)
        several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
        return s[new], number, several

    def select(self, keep: np.ndarray) -> None:
        for k in ("begin", "count", "anchor", "doc", "hash"):
            setattr(self, k, getattr(self, k)[keep])

    def spread(self, begin, size):
        """Places of the bytes of several strings, one after the other."""
        ends = np.cumsum(size)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)

    def distinct(self, buckets: int, doc_ids: np.ndarray):
        """Distinct runs by bucket: (bucket, representative, smallest doc_id), and
        for each run its number.  Equality is checked byte by byte."""
        size = self.count + LENGTH - 1
        x = words8(self.data)
        mixed = mix(x)
        place = self.spread(self.begin, size - 7)
        step = np.arange(len(place)) - np.repeat(np.cumsum(size - 7) - (size - 7), size - 7)
        h = mixed[place] * _powers(int(size.max(initial=0)))[step]
        cut = np.cumsum(size - 7) - (size - 7)
        h = mix(np.add.reduceat(h, cut) + size.astype(np.uint64)) if len(cut) else self.hash
        bucket = (self.hash >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((h, bucket))
        same = np.zeros(len(order), bool)
        same[1:] = (h[order[1:]] == h[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
        # check the bytes of each run that looks equal to the one before
        i = np.flatnonzero(same)
        if len(i):
            w = size[order[i]]
            differ = self.data[self.spread(self.begin[order[i]], w)] \
                != self.data[self.spread(self.begin[order[i - 1]], w)]
            bad = np.add.reduceat(differ, np.cumsum(w) - w) > 0
            same[i[bad]] = False
        new = np.flatnonzero(~same)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(~same) - 1
        low = np.minimum.reduceat(doc_ids[self.doc[order]], new) if len(new) else doc_ids[:0]
        return bucket[order[new]].astype(np.int64), order[new], low, number


_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        p = np.full(max(n, 256), _A | np.uint64(1), np.uint64)
        p[0] = 1
        _power = np.multiply.accumulate(p)
    return _power


def classes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of words: the order, and where a new class begins in it."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * _A + c.astype(np.uint64))
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    tie = np.flatnonzero(~new)
    for c in columns:
        if (c[order[tie]] != c[order[tie - 1]]).any():          # equal digests, other words
            order = np.lexsort(columns[::-1])
            new[:] = True
            differs = np.zeros(len(order) - 1, bool)
            for d in columns:
                differs |= d[order[1:]] != d[order[:-1]]
            new[1:] = differs
            break
    return order, np.flatnonzero(new)


def smaller_elsewhere(text, begin, count, shift, doc) -> np.ndarray:
    """For each window of the runs of one bucket: does a window equal to it
    belong to a run with a smaller doc_id?

    ``text`` has the runs one after the other from ``begin`` on; ``shift`` is
    the anchor's place in the run.
    """
    size = count + LENGTH - 1
    pad = -shift % MODULUS                                      # anchors on residue 0
    slot = (size + 2 * MODULUS - 1) // MODULUS * MODULUS
    at = np.cumsum(slot) - slot + pad
    t = np.zeros(int(slot.sum()) + 8, np.uint8)
    ends = np.cumsum(size)
    inner = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    place = np.repeat(at, size) + inner
    t[place] = text[np.repeat(begin, size) + inner]
    x = words8(t)
    # ranks of the samples at the difference cover
    sampled = np.isin(place % MODULUS, COVER) & (inner + SAMPLE <= np.repeat(size, size))
    q = place[sampled]
    order, new = classes([x[q + k] for k in (0, 8, 16, 24, 32, SAMPLE - 8)])
    rank = np.zeros(len(t), np.int64)
    rank[q[order]] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    # windows by the rank of their first sample and the bytes outside it
    to = np.cumsum(count)
    p = np.arange(int(to[-1])) + np.repeat(at - (to - count), count)
    step = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])
    d = step[p % MODULUS]
    bits = (8 * d).astype(np.uint64)
    head = x[p] & ((np.uint64(1) << bits) - np.uint64(1))
    tail = x[p + LENGTH - 8] >> (np.uint64(8 * (8 - MODULUS + 1)) + bits)
    order, new = classes([rank[p + d], head | (tail << bits), d])
    owner = np.repeat(doc, count)
    low = np.minimum.reduceat(owner[order], new)
    out = np.empty(len(p), bool)
    out[order] = np.repeat(low, np.diff(np.append(new, len(order)))) < owner[order]
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, offsets, data: the texts' bytes, compressed."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offsets = utf8(b.column(1))
            ids = b.column(0)
            for i, j in pieces(offsets, CHUNK):
                part = data[offsets[i] : offsets[j]].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())),
                    "offsets": pa.array([offsets[i : j + 1] - offsets[i]], pa.list_(pa.int64())),
                    "data": pa.array([pa.compress(part, "zstd", asbytes=True)], pa.binary())})
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "chunk long, doc_ids array<long>, offsets array<long>, data binary")


def _unpack(batch, k: int):
    """Chunk k of a batch with columns doc_ids, offsets, data at 1, 2, 3."""
    offsets = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
    raw = pa.decompress(batch.column(3)[k].as_py(), int(offsets[-1]), "zstd") if offsets[-1] else b""
    ids = batch.column(1)[k].values
    return np.frombuffer(raw, np.uint8), offsets, ids


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def shared_anchors(stored: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, bits): which of a chunk's anchors stand in two documents."""

    def tags(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, offsets, _ = _unpack(batch, k)
                key, _, several = Runs(data, offsets).tags(buckets)
                bucket = (key >> np.uint64(32)).astype(np.int64)
                new = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(new[1:], len(key))
                low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[new], pa.int64()),
                    "chunk": pa.array([batch.column(0)[k].as_py()] * len(new), pa.int64()),
                    "tags": pa.array([low[a:b].tobytes() for a, b in zip(new, ends)], pa.binary()),
                    "several": pa.array([np.packbits(several[a:b]).tobytes()
                                         for a, b in zip(new, ends)], pa.binary())})

    def meet(table):
        parts = [np.frombuffer(x, "<u4") for x in table.column("tags").to_pylist()]
        cut = np.cumsum([0] + [len(x) for x in parts])
        tag = np.concatenate(parts)
        several = np.concatenate([_bits(x, len(p)) for x, p in
                                  zip(table.column("several").to_pylist(), parts)])
        order = np.argsort(tag, kind="stable")
        new = np.flatnonzero(np.diff(tag[order].astype(np.int64), prepend=-1))
        many = np.diff(np.append(new, len(order)))
        hit = (many > 1) | np.logical_or.reduceat(several[order], new)
        out = np.empty(len(tag), bool)
        out[order] = np.repeat(hit, many)
        bits = [np.packbits(out[a:b]).tobytes() if out[a:b].any() else None
                for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                         "bits": pa.array(bits, pa.binary())}).filter(
            pa.array([b is not None for b in bits]))

    return (stored.mapInArrow(tags, "bucket long, chunk long, tags binary, several binary")
            .groupBy("bucket").applyInArrow(meet, "chunk long, bucket long, bits binary"))


def _per_chunk(bits: DataFrame, name: str) -> DataFrame:
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _kept_runs(data, offsets, shared, buckets: int) -> Runs:
    runs = Runs(data, offsets)
    key, number, _ = runs.tags(buckets)
    bucket = (key >> np.uint64(32)).astype(np.int64)
    hit = np.zeros(len(key), bool)
    for s in shared or []:
        a, b = np.searchsorted(bucket, [s["bucket"], s["bucket"] + 1])
        hit[a:b] = _bits(s["bits"], b - a)
    runs.select(hit[number])
    return runs


def repeated_windows(stored: DataFrame, shared: DataFrame, tag_buckets: int, buckets: int) -> DataFrame:
    """(chunk, bucket, bits): which windows of a chunk's distinct runs also start
    in a document with a smaller doc_id than those that hold the run."""

    def send(batches):
        for batch in batches:
            lists = batch.column(4).to_pylist()
            for k in range(batch.num_rows):
                data, offsets, ids = _unpack(batch, k)
                runs = _kept_runs(data, offsets, lists[k], tag_buckets)
                bucket, rep, low, _ = runs.distinct(buckets, _numbers(ids))
                new = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = []
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(bucket)]):
                    r = rep[a:b]
                    text = data[runs.spread(runs.begin[r], runs.count[r] + LENGTH - 1)]
                    parts = [runs.count[r].astype("<u2").tobytes(),
                             (runs.anchor[r] - runs.begin[r]).astype("<u2").tobytes(),
                             low[a:b].astype("<i8").tobytes(), text.tobytes()]
                    raw = b"".join(parts)
                    out.append((b - a, len(raw), pa.compress(raw, "zstd", asbytes=True)))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[new], pa.int64()),
                    "chunk": pa.array([batch.column(0)[k].as_py()] * len(new), pa.int64()),
                    "n": pa.array([x[0] for x in out], pa.int64()),
                    "size": pa.array([x[1] for x in out], pa.int64()),
                    "runs": pa.array([x[2] for x in out], pa.binary())})

    def sort_bucket(table):
        count, shift, low, text = [], [], [], []
        for n, size, raw in zip(table.column("n").to_pylist(), table.column("size").to_pylist(),
                                table.column("runs").to_pylist()):
            raw = np.frombuffer(pa.decompress(raw, size, "zstd"), np.uint8)
            count.append(raw[: 2 * n].view("<u2").astype(np.int64))
            shift.append(raw[2 * n : 4 * n].view("<u2").astype(np.int64))
            low.append(raw[4 * n : 12 * n].tobytes())
            text.append(raw[12 * n :])
        cut = np.cumsum([0] + [int(c.sum()) for c in count])
        count, shift = np.concatenate(count), np.concatenate(shift)
        size = count + LENGTH - 1
        hit = smaller_elsewhere(np.concatenate(text), np.cumsum(size) - size, count, shift,
                                np.frombuffer(b"".join(low), "<i8"))
        bits = [pa.compress(np.packbits(hit[a:b]).tobytes(), "zstd", asbytes=True)
                if hit[a:b].any() else None for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                         "bits": pa.array(bits, pa.binary())}).filter(
            pa.array([b is not None for b in bits]))

    told = stored.join(_per_chunk(shared, "shared"), "chunk").select(
        "chunk", "doc_ids", "offsets", "data", "shared")
    return (told.mapInArrow(send, "bucket long, chunk long, n long, size long, runs binary")
            .groupBy("bucket").applyInArrow(sort_bucket, "chunk long, bucket long, bits binary"))


def remove(stored: DataFrame, shared: DataFrame, repeated: DataFrame,
           tag_buckets: int, buckets: int) -> DataFrame:
    """doc_id, n_bytes, removed array<struct<start, end>>, kept binary."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            first, second = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for k in range(batch.num_rows):
                data, offsets, ids = _unpack(batch, k)
                gone = np.zeros(len(data), bool)
                if first[k]:
                    gone = _gone(data, offsets, _numbers(ids), first[k], second[k])
                yield _rows(data, offsets, ids, gone)

    def _gone(data, offsets, doc_ids, shared_, repeated_):
        runs = _kept_runs(data, offsets, shared_, tag_buckets)
        bucket, rep, low, number = runs.distinct(buckets, doc_ids)
        windows = runs.count[rep]
        at = np.cumsum(windows) - windows
        hit = np.zeros(int(windows.sum()), bool)
        for s in repeated_ or []:
            a, b = np.searchsorted(bucket, [s["bucket"], s["bucket"] + 1])
            n = int(windows[a:b].sum())
            packed = pa.decompress(s["bits"], (n + 7) // 8, "zstd", asbytes=True)
            hit[at[a] : at[a] + n] = _bits(packed, n)
        mark = hit[runs.spread(at[number], runs.count)] | np.repeat(
            doc_ids[runs.doc] > low[number], runs.count)
        places = runs.spread(runs.begin, runs.count)[mark]
        start = np.zeros(len(data), np.int64)
        start[places] = 1
        total = np.cumsum(start)
        before = np.zeros_like(total)
        before[LENGTH:] = total[:-LENGTH]
        return total > before

    def _rows(data, offsets, ids, gone):
        n = len(offsets) - 1
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        edge[inner] = gone[inner]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        stops = offsets[1:][np.diff(offsets) > 0] - 1
        last[stops] = gone[stops]
        a, b = np.flatnonzero(edge), np.flatnonzero(last) + 1
        doc = np.searchsorted(offsets, a, "right") - 1
        spans = [[] for _ in range(n)]
        for d, x, y in zip(doc.tolist(), (a - offsets[doc]).tolist(), (b - offsets[doc]).tolist()):
            spans[d].append({"start": x, "end": y})
        stay = data[~gone]
        cut = np.concatenate(([0], np.cumsum(~gone)))[offsets]
        raw = stay.tobytes()
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(offsets)), pa.array(spans, span),
             pa.array([raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())],
            ["doc_id", "n_bytes", "removed", "kept"])

    told = (stored.join(_per_chunk(shared, "shared"), "chunk", "left")
            .join(_per_chunk(repeated, "repeated"), "chunk", "left")
            .select("chunk", "doc_ids", "offsets", "data", "shared", "repeated"))
    return told.mapInArrow(run, "doc_id long, n_bytes long, "
                                "removed array<struct<start:long,end:long>>, kept binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed array<struct<start, end>>, kept binary."""
    stored = written(chunks(docs), "chunks", "none")
    size = stored.agg(F.sum(F.element_at("offsets", -1))).first()[0] or 0
    tag_buckets, buckets = max(48, size // (2 * BUCKET)), max(48, size // BUCKET)
    shared = written(shared_anchors(stored, tag_buckets), "shared")
    repeated = written(repeated_windows(stored, shared, tag_buckets, buckets), "repeated")
    return remove(stored, shared, repeated, tag_buckets, buckets)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(read(spark, sf_dir, "documents"))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", cut.alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
