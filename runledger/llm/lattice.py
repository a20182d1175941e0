"""Near-duplicate vectors by lattice hashing.

A table projects the unit vectors by a random matrix to eight dimensions and
decodes them to points of the E8 lattice.  A vector owns the cell of its
nearest point and probes the ``PROBES`` next ones; two vectors meet where one
owns a cell that the other owns or probes, in any of ``TABLES`` tables.  At
cosine 0.93 a table finds about 0.85 of the pairs (more for closer ones), so all
together miss about one in ten thousand.  Cosine is then computed for every pair
that meets, in double precision.

Equal vectors of one label are one class from the start.  A cell's members are
compared in blocks of at most ``BLOCK`` against each other, so no task holds an
unbounded cell; what leaves a block is a count and a local root per member, not
pairs.  A pair that meets in several cells counts in the first of them only.
(All links of n vectors in one cell are counted by n * n / BLOCK row copies.)

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component, or whose label is null, links with nothing; vectors of different
length do not link; repeated rows are linked copies; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import read, written
from runledger.llm.graph import components
from runledger.llm.words import mix

COSINE = 0.93
TABLES = 5
PROBES = 4
SCALE = 2.0
BLOCK = 4096


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight of 1/2
    or -1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for p in (1.0, -1.0):
                for q in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = p, q
                    out.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


_NEAR = _minimal_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cells(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of the owned cell and the probed ones: rows x TABLES x (1 + PROBES)."""
    n, dim = unit.shape
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        matrix = np.random.default_rng([t, dim]).normal(size=(dim, 8)) / SCALE
        x = unit @ matrix
        point = decode(x)
        distance = (_NEAR**2).sum(1) - 2 * (x - point) @ _NEAR.T
        next_ones = np.argpartition(distance, PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([point[:, None], point[:, None] + _NEAR[next_ones]], axis=1)
        key = np.repeat(salt[:, None] + np.uint64(t), 1 + PROBES, axis=1)
        for k in range(8):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15)
                      + (2 * points[:, :, k]).astype(np.int64).view(np.uint64))
        out[:, t] = key
    return out


def _units(blobs: list[bytes], dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def prepare(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, vec (bytes; null if it links with nothing), digests a, b."""
    wide = "double" in vectors.schema["embedding"].dataType.simpleString()
    dtype = np.dtype("<f8" if wide else "<f4")

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            blobs, a, b = [], [], []
            for v, label in zip(batch.column(2), batch.column(1).to_pylist()):
                values = v.values if v.is_valid else None
                x = None
                if values is not None and len(values) and not values.null_count and label is not None:
                    x = values.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                blobs.append(None if x is None else x.tobytes())
                d = hashlib.blake2b(f"{label}:".encode() + (blobs[-1] or b""), digest_size=16).digest()
                a.append(int.from_bytes(d[:8], "big", signed=True))
                b.append(int.from_bytes(d[8:], "big", signed=True))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + n)), batch.column(0), batch.column(1),
                 pa.array(blobs, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                ["row", "vec_id", "label", "vec", "a", "b"])
            number += n

    return vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(
        run, "row long, vec_id long, label long, vec binary, a long, b long")


def _entries(classes: DataFrame, dtype, with_vectors: bool) -> DataFrame:
    """A row for every cell that a class owns or probes."""
    width = 1 + PROBES

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            many = batch.column(1).to_numpy(zero_copy_only=False)
            label = batch.column(2).to_numpy(zero_copy_only=False)
            blobs = batch.column(3).to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(blobs):
                by_size.setdefault(len(v), []).append(k)
            for size, at in by_size.items():
                unit = _units([blobs[k] for k in at], dtype)
                salt = mix(label[at].view(np.uint64) * np.uint64(1009) + np.uint64(size))
                keys = cells(unit, salt)
                per = TABLES * width
                flat = keys.reshape(-1).view(np.int64)
                owner = np.tile(np.arange(per) % width == 0, len(at))
                cols = [pa.array(flat), pa.array(np.repeat(nodes[at], per)), pa.array(owner)]
                names = ["key", "node", "owner"]
                if with_vectors:
                    raw = [keys[k].tobytes() for k in range(len(at))]
                    cols += [pa.array(np.repeat(many[at], per)),
                             pa.array([blobs[k] for k in at for _ in range(per)], pa.binary()),
                             pa.array([r for r in raw for _ in range(per)], pa.binary())]
                    names += ["many", "vec", "cells"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "key long, node long, owner boolean"
    if with_vectors:
        schema += ", many long, vec binary, cells binary"
    return classes.select("node", "many", "label", "vec").mapInArrow(run, schema)


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The key of the one cell in which a pair counts; x and y are the cells of
    the smaller and the larger node of each pair."""
    key = np.zeros(len(x), np.uint64)
    open_ = np.ones(len(x), bool)
    for t in range(TABLES):
        own_x, own_y = x[:, t, 0], y[:, t, 0]
        for hit, where in ((own_x == own_y, own_x),
                           ((x[:, t, 1:] == own_y[:, None]).any(1), own_y),
                           ((y[:, t, 1:] == own_x[:, None]).any(1), own_x)):
            hit = hit & open_
            key[hit] = where[hit]
            open_ &= ~hit
    return key


def _compare(key, nodes, owner, block, many, blobs, raw, dtype, bar):
    """Links added to each member of one block pair, and its local root."""
    unit = _units(blobs, dtype)
    grid = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), TABLES, 1 + PROBES)
    added = np.zeros(len(nodes), np.int64)
    root = np.arange(len(nodes))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    linked = np.zeros(len(nodes), bool)
    one = block.min() == block.max()
    left = np.arange(len(nodes)) if one else np.flatnonzero(block == block.min())
    right = left if one else np.flatnonzero(block != block.min())
    for c in range(0, len(left), 256):
        rows = left[c : c + 256]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= bar)
        i, j = rows[i], right[j]
        meet = (owner[i] | owner[j]) & (nodes[i] < nodes[j] if one else nodes[i] != nodes[j])
        i, j = i[meet], j[meet]
        if not len(i):
            continue
        linked[i] = linked[j] = True
        first = np.flatnonzero(np.diff(i, prepend=-1))        # i comes in runs
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(i)]):
            r = find(int(i[a]))
            for other in np.unique(j[a:b]).tolist():
                root[find(other)] = r
        swap = nodes[i] > nodes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        counts = _first_meeting(grid[i], grid[j]) == np.uint64(key & (2**64 - 1))
        np.add.at(added, i[counts], many[j[counts]])
        np.add.at(added, j[counts], many[i[counts]])
    at = np.flatnonzero(linked)
    return nodes[at], added[at], nodes[[find(k) for k in at.tolist()]] if len(at) else nodes[at]


def compare(blocks: DataFrame, dtype, bar: float) -> DataFrame:
    """node, added, root of every block pair; blocks come clustered and sorted."""
    names = ["key", "i", "j", "node", "owner", "block", "many", "vec", "cells"]

    def groups(table):
        key = [table.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        change = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)
                                | (np.diff(key[2]) != 0)) + 1
        return np.concatenate(([0], change, [table.num_rows]))

    def solve(table, a, b, out):
        if b - a < 2:
            return
        part = table.slice(a, b - a)
        owner = part.column(4).to_numpy(zero_copy_only=False)
        block = part.column(5).to_numpy(zero_copy_only=False)
        cross = part.column(1)[0].as_py() != part.column(2)[0].as_py()
        if not owner.any() or cross and block.min() == block.max():
            return                  # nothing to meet; or one of two blocks is empty
        got = _compare(int(part.column(0)[0].as_py()),
                       part.column(3).to_numpy(zero_copy_only=False), owner, block,
                       part.column(6).to_numpy(zero_copy_only=False),
                       part.column(7).to_pylist(), part.column(8).to_pylist(), dtype, bar)
        if len(got[0]):
            out.append(got)

    def emit(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)],
            ["node", "added", "root"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            table = table.combine_chunks()
            bounds, out = groups(table), []
            for a, b in zip(bounds[:-2].tolist(), bounds[1:-1].tolist()):
                solve(table, a, b, out)
            rest = table.slice(int(bounds[-2]))      # may go on in the next batch
            if out:
                yield emit(out)
        out = []
        if rest is not None:
            solve(rest.combine_chunks(), 0, rest.num_rows, out)
        if out:
            yield emit(out)

    return blocks.select(names).mapInArrow(run, "node long, added long, root long")


def near_duplicates(vectors: DataFrame, bar: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row."""
    dtype = np.dtype("<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4")
    found = written(prepare(vectors), "vectors")
    valid = found.where(F.col("vec").isNotNull())
    classes = written(valid.groupBy("a", "b").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("first"),
        F.first("label").alias("label"), F.first("vec").alias("vec")), "classes")
    # cells with more members than a block are dealt into block pairs
    big = (_entries(classes, dtype, False).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > block)
           .select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    e = _entries(classes, dtype, True).join(big, "key", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1)))
    e = e.withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    e = e.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    e = e.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = written(compare(e, dtype, bar), "links")
    added = links.groupBy("node").agg(F.sum("added").alias("added"))
    star = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v").distinct())
    of = (classes.select("node", "a", "b", "many", "first").join(added, "node", "left")
          .join(star.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left")
          .withColumn("label", F.coalesce("label", "node")))
    heads = of.groupBy("label").agg(F.min("first").alias("component_id"))
    of = of.join(heads, "label").select(
        "a", "b", "component_id", (F.coalesce("added", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    alone = found.where(F.col("vec").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = valid.select("vec_id", "a", "b").join(of, ["a", "b"]).select(
        "vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
