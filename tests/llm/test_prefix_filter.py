"""Near-duplicates in one hot group of edited copies without a clean original."""

import random

import pytest

from runledger.llm import order_minhash as M
from tests.llm.conftest import prose


def copies(seed, n, words=120, most=7, clean=False):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = [" ".join(base)] if clean else []
    while len(out) < n:
        w = list(base)
        for _ in range(rng.randint(1, most)):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice([[], [w[i] + rng.choice("xyz")], [w[i], rng.choice(["added", "more"])]])
        out.append(" ".join(w))
    return out


def brute(texts):
    kmers = [M._kmers(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and M.aligned(kmers[i], kmers[j]) >= 0.8:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed,clean,most", [(1, True, 7), (2, False, 7), (3, False, 3)])
def test_hot_group(docs_of, seed, clean, most):
    texts = copies(seed, 260, most=most, clean=clean) + [prose(90 + i, 60) for i in range(20)]
    got = {r.rec.doc_id: r.group_id for r in M.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("bar", [0.8, 0.6])
def test_prefix_pairs_miss_no_similar_pair(spark, bar):
    rng = random.Random(4)
    texts = copies(5, 60, 40, 4) + copies(6, 40, 12, 2) + ["a b c d e", "a b c d e f", "a b c d f"]
    texts += [" ".join(t.split()[:rng.randint(5, 40)]) for t in copies(5, 40, 40, 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    entries = M.prefixes(frame, frame.select("node"), bar)
    alone = spark.createDataFrame([], "u long, v long")
    got = {(r.u, r.v) for r in M.prefix_pairs(entries, alone, bar).collect()}
    kmers = [M._kmers(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if M.aligned(kmers[i], kmers[j], bar) >= bar}
    assert want <= got
    # one component pairs nothing
    one = spark.createDataFrame([(i, 0) for i in range(1, len(texts))], "u long, v long")
    assert M.prefix_pairs(entries, one, bar).count() == 0
