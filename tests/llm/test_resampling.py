"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from runledger.llm import resampling as R
from tests.llm.conftest import prose
from tests.llm.test_documents import word_list
from tests.oracle import compare


def brute(rows, target, percent, min_words, ngrams, buckets, seed=R.SEED):
    def features(text):
        w = word_list(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets
                for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in features(text):
            s[f] += 1
    for text in target:
        for f in features(text):
            t[f] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1.0) * (sum(s) + float(buckets))
                                       / ((s[i] + 1.0) * (sum(t) + float(buckets))))) for i in range(buckets)]
    out = []
    for d, text in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[f] for f in features(text))
        out.append([d, len(features(text)), w,
                    w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(word_list(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("ngrams,percent", [(1, 10), (2, 50), (3, 100)])
def test_sample_is_the_plain_one(spark, docs_of, odd_rows, ngrams, percent):
    rows = odd_rows + [(100 + i, prose(i, 5 + i % 60)) for i in range(200)] + [(-5, "y" * 200 + " b")]
    target = [prose(900 + i, 30) for i in range(5)] + [None, "", "river z" + "q" * 100]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, a string")
    got = R.resample(docs_of(rows), bench, percent, 5, ngrams, 97)
    assert key(rows_of(got)) == key(brute(rows, target, percent, 5, ngrams, 97))


def test_repeated_rows_fill_the_room_that_is_left(spark, docs_of):
    rows = [(3, prose(3, 30))] * 40 + [(i, prose(i, 30)) for i in range(50, 70)]
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    got = rows_of(R.resample(docs_of(rows), bench, 50, 20))
    assert key(got) == key(brute(rows, [prose(1, 30)], 50, 20, 1, R.BUCKETS))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 31))


def test_empty_tables(spark, docs_of):
    none = docs_of([]).select("doc_id", "text", "lang")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(R.resample(none, bench)) == []
    rows = [(i, prose(i, 25)) for i in range(30)] + [(90, "a")]
    assert key(rows_of(R.resample(docs_of(rows), bench))) == key(brute(rows, [], 10, 20, 1, R.BUCKETS))
    few = docs_of([(1, "a b"), (2, None)])
    assert all(r[4] is None for r in rows_of(R.resample(few, bench)))


def test_crc_of_pieces():
    rng = random.Random(4)
    texts = [bytes(rng.randrange(1, 256) for _ in range(rng.choice([0, 1, 3, 8, 63, 64, 65, 300]))) for _ in range(400)]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], ends[:-1]))
    one = R.crc_extend(np.zeros(len(texts), np.uint32), data, starts, ends)
    assert one.tolist() == [zlib.crc32(t) for t in texts]
    two = R.crc_extend(one, data, starts[::-1], ends[::-1])
    assert two.tolist() == [zlib.crc32(a + b) for a, b in zip(texts, texts[::-1])]


@pytest.mark.parametrize("seed", range(3))
def test_cutoff_is_exact_at_every_rank(spark, seed):
    rng = random.Random(seed)
    keys = [(rng.randrange(5), rng.randrange(8)) for _ in range(90)] + [(2, 2)] * 60  # ties, one key hot
    df = spark.createDataFrame(keys, "a long, b long").repartition(7).cache()
    keys.sort()
    for rank in [1, 2, 75, 149, 150]:
        assert R.cutoff(df, rank) == keys[rank - 1]
    with pytest.raises(ValueError):
        R.cutoff(df, 151)


def test_rounds_discard_a_guaranteed_share(spark):
    df = spark.range(40_000).selectExpr("id * id % 39979 as a", "id as b").repartition(11).cache()
    rounds = []
    plain = R._sides
    try:
        R._sides = lambda *x: rounds.append(x) or plain(*x)
        want = df.orderBy("a", "b").limit(31_000).collect()[-1]
        assert R.cutoff(df, 31_000) == tuple(want)
    finally:
        R._sides = plain
    assert len(rounds) <= 2 + math.log(40_000) / -math.log(7 / 8)


def test_oracle(spark, sf, con):
    assert compare(R.op11_importance_resampling(spark, sf), con, R.ORACLE) is None
