"""Connected components: results, and how often a round deals the edges anew."""

import random

import numpy as np
import pyarrow as pa

from runledger.llm import graph
from runledger.llm import order_minhash as M
from tests.llm.conftest import prose


def roots(links):
    label = {x: x for link in links for x in link}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for u, v in links:
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in label if root(x) != x}


def test_components_of_mixed_shapes(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)]                                  # a chain
    links += [(i, 200) for i in range(100, 160)]                             # a hub above its neighbours
    links += [(300, i) for i in range(301, 340)]                             # and one below
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    links += links[::3] + [(v, u) for u, v in links[::5]] + [(7, 7), (900, 900)]
    rng.shuffle(links)
    rows = graph.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(rows) == len({r.u for r in rows})
    assert {(r.u, r.v) for r in rows} == roots(links)


def test_a_round_of_components_shuffles_three_times(spark, monkeypatch):
    plans = []

    def written(df, name, compression="zstd"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name, compression)

    kept = graph.written
    monkeypatch.setattr(graph, "written", written)
    option = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(option)
    spark.conf.set(option, "-1")
    try:
        graph.components(spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "u long, v long"))
    finally:
        spark.conf.set(option, before)
    assert plans and max(p.count("Exchange hashpartitioning") for p in plans) <= 3


def test_kmers_of_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(M, "PIECE", 300)
    texts = [prose(1, 80), "", None, "a b", prose(2, 20), "x " * 30, prose(3, 200), ""]
    got = M._labelled(pa.array(texts, pa.string()))
    assert len(got) == len(texts)
    assert all(np.array_equal(g, M._kmers(t)) for g, t in zip(got, texts))
    assert M._labelled(pa.array([], pa.string())) == []
