"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics``: counts and ratios of every whole text, in one pass.
2. ``learn``: shallow trees over the statistics of labelled rows; each path
   from a root is a conjunctive rule; a logistic regression with an L1 penalty
   weighs the rules, and most weights become zero.
3. ``RuleModel.score``: the rules with weights, compiled into one Spark column
   expression (no Python when scoring).

Fitting reads at most about ``MAX_LABELLED`` labelled rows, taken by a hash of
doc_id; everything else covers all rows.

Defined cases: a null or empty text has all statistics 0 and is scored like
any other; rows without a label or with a null label are not learned from; a
doc_id labelled several times has label 1 if at least half of its labels are 1;
with no labelled rows, or one class only, the score is the smoothed share of
label 1 (0.5 without labels); repeated rows are scored each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import words
from runledger.llm.common import TEXT_ROWS, batch_rows, carried, pieces, read, utf8, with_fields, written

THRESHOLD = 0.3
MAX_LABELLED = 20_000
TREES = 12
DEPTH = 3
PENALTY = 0.002
PIECE = 1 << 20          # bytes of text worked on together

STATISTICS = [
    "log_words", "word_length", "upper", "marks_per_word", "stops_per_word", "distinct",
    "adjacent_repeats", "top_word", "digits", "words_per_line", "non_ascii", "short_words",
    "spaces",
]

_byte = np.arange(256)
_CLASS = {
    "upper": (_byte >= 65) & (_byte <= 90),
    "letter": (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122),
    "digit": (_byte >= 48) & (_byte <= 57),
    "stop": np.isin(_byte, [ord(c) for c in ".,;:?"]),
    "mark": np.isin(_byte, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]),
    "space": np.isin(_byte, [9, 10, 13, 32]),
    "line": _byte == 10,
    "char": (_byte < 128) | (_byte >= 192),      # first bytes of code points
    "wide": _byte >= 192,
}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = {k: _sums(c[data], offsets) for k, c in _CLASS.items()}
    low, s, e, row = words.split(data, offsets)
    h = words.hashes(low, s, e)
    count, size = np.diff(row), e - s
    doc = np.repeat(np.arange(len(count)), count)
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(key)))
    distinct = np.bincount((key[at] >> np.uint64(40)).astype(np.int64), minlength=len(count))
    top = np.zeros(len(count), np.int64)
    np.maximum.at(top, (key[at] >> np.uint64(40)).astype(np.int64), many)
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    def share(a, b):
        return np.divide(a, b, out=np.zeros(len(count)), where=b > 0)

    return np.column_stack([
        np.log1p(count), share(_sums(size, row), count), share(n["upper"], n["letter"]),
        share(n["mark"], count), share(n["stop"], count), share(distinct, count),
        share(_sums(repeat, row), count), share(top, count), share(n["digit"], n["char"]),
        share(count, n["line"] + 1), share(n["wide"], n["char"]),
        share(_sums(size <= 3, row), count), share(n["space"], n["char"])])


def statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``rec`` and the statistics of the whole text, one row per row."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            out = np.zeros((b.num_rows, len(STATISTICS)))
            for i, j in pieces(offsets, PIECE):
                out[i:j] = _describe(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in out.T)],
                ["rec", *STATISTICS])

    out, rec = carried(docs, carry)
    return out.mapInArrow(run, with_fields(rec, ", ".join(f"{s} double" for s in STATISTICS)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


Condition = tuple[str, str, float]        # statistic, "<=" or ">", threshold


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]     # conditions, weight

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, op, t in conditions:
        out = out & (F.col(name) <= t if op == "<=" else F.col(name) > t)
    return out


def paths(forest) -> list[tuple[Condition, ...]]:
    """Every path from a root to a node, as bounds per statistic."""
    found = set()

    def walk(node, bounds):
        if bounds:
            found.add(tuple(sorted((f, op, t) for (f, op), t in bounds.items())))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, t = STATISTICS[split.featureIndex()], split.threshold()
        low, high = dict(bounds), dict(bounds)
        low[name, "<="] = min(t, low.get((name, "<="), math.inf))
        high[name, ">"] = max(t, high.get((name, ">"), -math.inf))
        walk(node.leftChild(), low)
        walk(node.rightChild(), high)

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return sorted(found)


def learn(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> RuleModel:
    """Fit on the labelled rows that are not held out."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    marked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
              .where(~held_out()))
    n = marked.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 20))
    # at most about max_rows rows: picked by all tasks, then few enough for a few
    rows = written(stats.where(share).join(marked.where(share), "doc_id"), "labelled").coalesce(4)
    total, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    ones = ones or 0
    if not 0 < ones < total:
        return RuleModel(math.log((ones + 1) / (total - ones + 1)), ())
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="x", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.6,
        featureSubsetStrategy="0.5", seed=11).fit(vectors.select("x", "label"))
    rules = paths(forest)
    if not rules:
        return RuleModel(math.log((ones + 1) / (total - ones + 1)), ())
    fired = rows.select("label", *(holds(r).cast("double").alias(f"r{k}")
                                   for k, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x"
                            ).transform(fired).select("x", "label")
    fit = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=PENALTY,
                             maxIter=60).fit(fired)
    weights = fit.coefficients.toArray().tolist()
    return RuleModel(float(fit.intercept), tuple(
        (r, w) for r, w in zip(rules, weights) if w != 0.0))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             carry: list[str] | None = None) -> DataFrame:
    """``rec``, held_out, score, predicted; one row per document row."""
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        stats = written(statistics(docs, carry), "statistics")
    model = learn(stats.select("rec.doc_id", *STATISTICS), labels)
    return stats.select("rec", held_out("rec.doc_id").alias("held_out"), model.score().alias("score")
                        ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
                   carry=["doc_id"])
    return out.select("rec.doc_id", "held_out", "score", "predicted")
