"""Near-duplicate documents by Order MinHash.

The k-mers are shingles of five words, labelled with their occurrence number in
the document.  A sketch takes the ``DEPTH`` smallest labelled k-mers under its
own hash and keeps them in text order, so two documents share it when they have
the same k-mers in the same order; ``SKETCHES`` sketches find a pair of
similarity 0.8 with probability over 0.9999.

Similarity is edit similarity on k-mers: the labelled k-mers that a banded
alignment can match in order, over all labelled k-mers of both documents (with
nothing moved, the Jaccard index of the multisets).  The band is as wide as the
pair's similarity bound allows, so it loses no alignment that counts.

Documents with the same words are one class from the start, found by a 128-bit
digest and pre-aggregated in every task.  Classes are linked in rounds:

1. every class of a bucket with the bucket's smallest class;
2. in buckets that still hold several components, with the member that has the
   fewest k-mers of its own;
3. the classes of those buckets that could still link components, by an exact
   prefix filter: a class's k-mers are ordered by rarity, and similar classes
   must share one of the first of them.  How many count follows from both lengths
   (lengths go by bands of ``BAND``), and the places where the shared k-mer
   stands bound what the classes can share at all.  K-mers that only one component
   holds pair nothing, and of the others the largest component meets the rest only.

Classes that are connected already are not compared again: their component
would not change.  Before rounds 2 and 3 the k-mers of the classes still open
are counted: one that shares fewer of them with all the others together than the
bar asks of it cannot be similar to any.

Defined cases: a document of fewer than five words has all of them as its one
k-mer; texts without words are equal if their characters are; a null text is
empty; repeated rows are copies; of each group the row with the smallest doc_id
stays (nulls last, then any one row); an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm import words
from runledger.llm.common import TEXT_ROWS, batch_rows, carried, pieces, read, utf8, with_fields, written
from runledger.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
DEPTH = 3
BAND = 1.05
PIECE = 1 << 20          # bytes of text worked on together
VERIFY_ROWS = 500

_rng = np.random.default_rng(77)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SEED = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_LABEL = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(2**64 - 1)


def labelled(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of word hashes, and the rows' bounds in them."""
    count = np.diff(row)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(n)))
    begin = np.repeat(row[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    s = np.zeros(len(begin), np.uint64)
    short = np.repeat(count < SHINGLE, n)
    end = np.repeat(row[1:], n)
    for j in range(SHINGLE):
        at = begin + j
        if short.any():
            inside = at < end
            s[inside] += h[at[inside]] * _STEP[j]
        else:
            s += h[at] * _STEP[j]
    s = words.mix(s)
    # the how-manieth equal k-mer of the document
    doc = np.repeat(np.arange(len(count)), n).astype(np.uint64)
    key = (doc << np.uint64(40)) | (s >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    if not first.all():
        place = np.arange(len(key))
        nth = place - np.maximum.accumulate(np.where(first, place, 0))
        label = np.empty(len(key), np.uint64)
        label[order] = nth
        again = label > 0                            # first occurrences stay as they are
        s[again] = words.mix(s[again] + label[again] * _LABEL)
    return s, bounds


def sketches(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``SKETCHES`` keys per document; documents have k-mers."""
    n = np.diff(bounds)
    out = np.zeros((len(n), SKETCHES), np.uint64)
    for t in range(SKETCHES):
        v = (s ^ _SEED[t]) * _FACTOR[t]
        places = np.full((len(n), DEPTH), np.iinfo(np.int64).max)
        for d in range(DEPTH):
            low = np.minimum.reduceat(v, bounds[:-1])
            at = np.flatnonzero(v == np.repeat(low, n))
            doc = np.searchsorted(bounds, at, "right") - 1
            live = low[doc] != _TOP
            at, doc = at[live], doc[live]
            places[doc[::-1], d] = at[::-1]          # the first, should values tie
            v[at] = _TOP
        places.sort(axis=1)                          # text order
        key = np.full(len(n), np.uint64(t + 1))
        for d in range(DEPTH):
            there = places[:, d] < len(s)
            key[there] = words.mix(key[there] * _LABEL + s[places[there, d]])
        out[:, t] = key
    return out


def _digests(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's sequence of words."""
    count = np.diff(row)
    at = (np.arange(len(h)) - np.repeat(row[:-1], count)).astype(np.uint64)
    total = np.zeros((2, len(h) + 1), np.uint64)
    for k in (0, 1):
        np.cumsum(words.mix(h + at * _LABEL + np.uint64(k * 1001)), out=total[k, 1:])
    n = count.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return tuple(words.mix(total[k, row[1:]] - total[k, row[:-1]] + n) for k in (0, 1))


def sketch(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``rec``, row, text, digests a and b, number of k-mers n, keys."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            m = batch.num_rows
            a, b, n = np.zeros(m, np.uint64), np.zeros(m, np.uint64), np.zeros(m, np.int64)
            keys = np.zeros((m, SKETCHES), np.uint64)
            for i, j in pieces(offsets, PIECE):
                part = data[offsets[i] : offsets[j]]
                low, s, e, row = words.split(part, offsets[i : j + 1] - offsets[i])
                h = words.hashes(low, s, e)
                a[i:j], b[i:j] = _digests(h, row)
                v, bounds = labelled(h, row)
                n[i:j] = np.diff(bounds)
                some = np.flatnonzero(n[i:j])
                if len(some):
                    keys[i + some] = sketches(v, np.append(bounds[some], bounds[-1]))
            for k in np.flatnonzero(n == 0).tolist():
                d = hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=16)
                a[k], b[k] = np.frombuffer(d.digest(), np.uint64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, SKETCHES, 0)))), pa.int32()),
                pa.array(keys[n > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(number, number + m)),
                 batch.column(1), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.array(n), lists],
                ["rec", "row", "text", "a", "b", "n", "keys"])
            number += m

    out, rec = carried(docs, carry)
    return out.mapInArrow(run, with_fields(
        rec, "row long, text string, a long, b long, n long, keys array<long>"))


def _labelled(texts: pa.Array) -> list[np.ndarray]:
    """The labelled k-mers of each text, in text order."""
    data, offsets = utf8(texts)
    out = []
    for i, j in pieces(offsets, PIECE):
        low, s, e, row = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        kmers, bounds = labelled(words.hashes(low, s, e), row)
        out += np.split(kmers, bounds[1:-1])
    return out


def _kmers(text: str) -> np.ndarray:
    return _labelled(pa.array([text], pa.string()))[0]


def aligned(x: np.ndarray, y: np.ndarray, bar: float = SIMILARITY) -> float:
    """Similarity of two lists of labelled k-mers by banded alignment; 0 where
    it is sure to be below ``bar``."""
    least = bar / (1 + bar) * (len(x) + len(y))       # matches that ``bar`` needs
    if min(len(x), len(y)) < least:
        return 0.0
    same, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    band = len(x) + len(y) - 2 * least                # insertions and deletions allowed
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        m = len(j)
    else:                                             # longest increasing chain
        tails = np.empty(len(j), np.int64)
        m = 0
        for v in j.tolist():
            k = int(np.searchsorted(tails[:m], v))
            tails[k] = v
            m = max(m, k + 1)
    return m / (len(x) + len(y) - m)


def verify(pairs: DataFrame, texts: DataFrame, bar: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""

    def run(batches):
        for b in batches:
            v = b.column(1).to_numpy(zero_copy_only=False)
            begins = np.ones(len(v), bool)
            begins[1:] = v[1:] != v[:-1]              # rows come sorted by v
            left = _labelled(b.column(2))
            right = _labelled(b.column(3).filter(pa.array(begins)))
            at = (np.cumsum(begins) - 1).tolist()
            keep = np.array([aligned(x, right[k], bar) >= bar for x, k in zip(left, at)], bool)
            yield b.select([0, 1]).filter(pa.array(keep))

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("right"))
    # a hot v is on the left, large side, which a skew join splits
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "left", "right")
    # Two whole texts a row: few rows in a batch, so long texts do not add up.
    with batch_rows(pairs.sparkSession, VERIFY_ROWS):
        return small(both.mapInArrow(run, "u long, v long"), "links")


def _members(classes: DataFrame) -> DataFrame:
    """(key, node, n, center, center_n) of the buckets with several classes."""
    entries = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = (entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count(F.lit(1)).alias("m"))
               .where("m > 1").select("key", F.col("c.node").alias("center"), F.col("c.n").alias("center_n")))
    return small(entries.join(buckets, "key"), "members")


def _fits(n, other, bar: float):
    return F.least(n, other) >= F.lit(bar) * F.greatest(n, other)


def _mixed(members: DataFrame, star: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their label."""
    of = star.select(F.col("u").alias("node"), F.col("v").alias("label"))
    m = members.join(of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = (m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .where("low < high").select("key"))
    return m.join(split, "key")


def small(df: DataFrame, name: str) -> DataFrame:
    """``written`` for tables of numbers: cheap to compress, and many in number."""
    return written(df, name, "snappy")


def _least(x: F.Column) -> F.Column:
    """The smallest whole number that is at least x, up to rounding in doubles."""
    return F.ceil(x - F.lit(1e-9))


def prefixes(texts: DataFrame, nodes: DataFrame, bar: float) -> DataFrame:
    """The k-mers that can show a link between the nodes: (node, n, s, kmer, pos).

    s counts the labelled k-mers that a node shares with others of the nodes; nodes
    with fewer than ``bar`` * n are similar to none and left out.  ``pos`` is the place
    of a k-mer in the order of rarity (those of one node alone come first).  Two
    similar nodes share a k-mer among the first n - ceil(bar * n) + 1 of either.
    """

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            node = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets, PIECE):
                low, begin, end, row = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kmer, bounds = labelled(words.hashes(low, begin, end), row)
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[i:j], size), pa.int64()), pa.array(np.repeat(size, size)),
                     pa.array(kmer.view(np.int64))], ["node", "n", "kmer"])

    rows = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(
        run, "node long, n long, kmer long")
    # K-mers that the same nodes hold (one edit changes several) are one token: of those
    # only the first is kept, at its place among all.
    holder = F.xxhash64("node")
    shared = rows.groupBy("kmer").agg(
        F.count(F.lit(1)).alias("df"), F.bit_xor(holder).alias("x"),
        F.sum(holder.bitwiseAND(F.lit(0xFFFFFFFF))).alias("y")).where("df > 1")
    by_node = Window.partitionBy("node")
    in_order = by_node.orderBy("df", "x", "y", "kmer")
    token = F.struct("df", "x", "y")
    ranked = rows.join(shared, "kmer").select(
        "node", "n", "kmer", F.count(F.lit(1)).over(by_node).alias("s"), F.row_number().over(in_order).alias("r"),
        F.coalesce(F.lag(token).over(in_order) != token, F.lit(True)).alias("first"))
    n, s = F.col("n"), F.col("s")
    ranked = ranked.where("first").withColumn("pos", n - s + F.col("r") - 1).drop("r", "first")
    with batch_rows(texts.sparkSession, TEXT_ROWS):
        return small(ranked.where((s >= F.lit(bar) * n) & (F.col("pos") <= n - _least(F.lit(bar) * n))), "prefixes")


def prefix_pairs(entries: DataFrame, star: DataFrame, bar: float) -> DataFrame:
    """(u, v): all pairs of nodes of different components that the rarity-ordered
    prefixes, the lengths and the places allow to be similar."""
    of = star.select(F.col("u").alias("node"), F.col("v").alias("label"))
    e = entries.join(of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    need, n, pos = F.lit(bar / (1 + bar)), F.col("n"), F.col("pos")

    def band(x):
        return F.floor(F.log(x) / F.lit(math.log(BAND)) + F.lit(1e-9))

    # The shorter of a pair is looked up by the longer one, in the band of its length.
    index = e.where(pos <= n - _least(need * 2 * n)).select("kmer", band(n).alias("band"), F.lit(False).alias("probe"),
                                                            "node", "n", "pos", "label")
    low = _least(F.lit(bar) * n)
    probe = e.withColumn("band", F.explode(F.sequence(band(low), band(n))))
    low = F.greatest(low, F.ceil(F.pow(F.lit(BAND), F.col("band")) - F.lit(1e-6)))
    probe = probe.where(pos <= n - _least(need * (n + low))).select("kmer", "band", F.lit(True).alias("probe"),
                                                                    "node", "n", "pos", "label")
    both = index.unionByName(probe)
    at = ["kmer", "band"]
    per = both.groupBy(*at, "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = (per.groupBy(*at).agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("parts"))
             .where("parts > 1").drop("parts"))
    both = small(both.join(mixed, at).withColumn("rest", F.col("label") != F.col("main")).drop("main"), "prefix-entries")

    def side(df, name):
        return df.select(*at, F.struct("node", "n", "pos", "label").alias(name))

    longer, shorter = both.where("probe"), both.where("not probe")
    meet = (side(longer.where("rest"), "x").join(side(shorter, "y"), at)
            .unionByName(side(longer.where("not rest"), "x").join(side(shorter.where("rest"), "y"), at)))
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = ((F.col("x.label") != F.col("y.label")) & (F.col("x.n") >= F.col("y.n"))
            & (F.col("y.n") >= F.lit(bar) * F.col("x.n") - F.lit(1e-9))
            & (room >= _least(need * (F.col("x.n") + F.col("y.n")))))
    return meet.where(fits).select(F.greatest("x.node", "y.node").alias("u"), F.least("x.node", "y.node").alias("v")).distinct()


def link(classes: DataFrame, texts: DataFrame, bar: float) -> DataFrame:
    """(u, v): each class that is similar to others, with its component."""
    members = _members(classes)
    nodes = members.select("node").distinct()
    # the same plan at every size: texts are dealt by node, nodes never broadcast
    texts = written(texts.join(nodes.hint("merge"), "node", "left_semi"), "texts")
    tried = small(members.where(F.col("node") != F.col("center"))
                    .where(_fits(F.col("n"), F.col("center_n"), bar))
                    .select(F.col("node").alias("u"), F.col("center").alias("v")).distinct(), "pairs")
    star = components(verify(tried, texts, bar), "snappy")
    open_ = small(_mixed(members.select("key", "node", "n"), star), "open")
    entries = prefixes(texts, open_.select("node").distinct(), bar)
    # The rarest shared k-mer of an open node is in its prefix: one row for each.
    held = entries.groupBy("node").agg(F.max("s").alias("s"))
    for step in (2, 3):
        if step == 2:                # the member with the fewest k-mers of its own
            m = small(open_.join(held, "node"), "held")
            other = m.groupBy("key").agg(F.max(F.struct(
                (F.col("s") / F.col("n")).alias("share"), "node", "n", "s", "label")).alias("o"))
            least = F.lit(bar / (1 + bar)) * (F.col("n") + F.col("o.n"))
            pairs = (m.join(other, "key").where(F.col("label") != F.col("o.label"))
                     .where((F.col("s") >= least) & (F.col("o.s") >= least))
                     .select(F.greatest("node", "o.node").alias("u"), F.least("node", "o.node").alias("v")).distinct())
        else:
            pairs = prefix_pairs(entries, star, bar)
        pairs = small(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        found = verify(pairs, texts, bar)
        tried = tried.unionByName(pairs)
        if not found.isEmpty():
            star = components(star.unionByName(found), "snappy")
    return star


def near_duplicates(docs: DataFrame, bar: float = SIMILARITY, carry: list[str] | None = None) -> DataFrame:
    """``rec``, group_id (the smallest doc_id of the group) and kept (one row of
    each group)."""
    found = sketch(docs, carry)
    if "text" in found.schema["rec"].dataType.names:         # once is enough
        found = found.drop("text")
        text = "rec.text"
    else:
        text = "text"
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        found = written(found, "sketched")
    classes = written(
        found.groupBy("a", "b").agg(
            F.min(F.struct(F.col("rec.doc_id").isNull(), "rec.doc_id", "row")).alias("first"),
            F.min("row").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "classes")
    texts = found.select(F.col("row").alias("node"), F.col(text).alias("text"))
    star = link(classes.select("node", "n", "keys"), texts, bar)
    label = classes.select("a", "b", "first", "node").join(
        star.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    heads = label.groupBy("label").agg(F.min("first").alias("head"))
    owner = label.join(heads, "label").select("a", "b", "head")
    return found.select("rec", "row", "a", "b").join(owner, ["a", "b"]).select(
        "rec", F.col("head.doc_id").alias("group_id"),
        (F.col("row") == F.col("head.row")).alias("kept"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("rec.doc_id", "group_id", "kept")
