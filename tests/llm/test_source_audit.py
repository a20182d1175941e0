"""Source divergence against a plain computation."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from runledger.llm import source_audit as A
from tests.llm.conftest import prose
from tests.oracle import compare

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, min_docs, top):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        t = term_list(text)
        counts[lang or "", source or ""].update(t)
        df[lang or ""].update(set(t))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for i, (v, o) in enumerate(items[:top] if part == "term" else items):
                    out.append((lang, s, part, o, v, i + 1))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string, n long")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("n_cells,block", [(A.CELLS, A.BLOCK), (7, 2)])
def test_audit_is_the_plain_one(spark, odd_rows, n_cells, block):
    rng = random.Random(5)
    rows = [(prose(i, rng.randint(0, 40)) + rng.choice(["", " été 漢字 x9y", " Æ-z"]), rng.choice(["en", "en", "fr", None]),
             rng.choice(["a", "b", "b", "b", "é", None])) for i in range(150)]
    rows += [(t, "en", "a") for _, t in odd_rows] + [("rare words", "de", "one"), (None, "de", "two"), ("", "xx", "only")]
    rows += [(prose(3, 50), "en", "hot")] * 120
    got = A.divergences(frame(spark, rows), 4, 3, n_cells, block)
    assert rows_of(got) == brute(rows, 4, 3)


def test_empty_table(spark):
    assert rows_of(A.divergences(frame(spark, []))) == []


def test_a_batch_is_counted_in_small_shards():
    texts = [prose(i % 20, 1500) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 1500, "source": ["a"] * 1500, "text": texts})
    tracemalloc.start()
    found = Counter()
    for b in A._count_terms(iter([batch])):
        found.update({t: n for t, n in zip(b["term"].to_pylist(), b["n"].to_pylist()) if t})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == Counter(x for t in texts for x in term_list(t))
    assert peak < 5 * batch.nbytes


def test_pointers_are_sorted():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(500)]
    terms += ["a" * 8, "a" * 16, "a" * 24, "a" * 8] * 3
    data = np.frombuffer(b"".join(t.encode() for t in terms), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in terms])
    order, first = A.sort_pointers(data, np.concatenate(([0], ends[:-1])), ends)
    want = sorted(range(len(terms)), key=lambda i: (terms[i].encode(), i))
    assert order.tolist() == want
    assert first.tolist() == [i == 0 or terms[want[i]] != terms[want[i - 1]] for i in range(len(want))]


def test_shares_are_exact():
    rng = random.Random(2)
    n = [rng.randrange(10 ** rng.randint(1, 15)) for _ in range(300)]
    total = [x + 5 + rng.randrange(10 ** rng.randint(1, 15)) for x in n]
    assert A.shares(np.array(n), np.array(total)).tolist() == [1 + 10**9 * (a + 5) // b for a, b in zip(n, total)]


def test_oracle(spark, sf, con):
    assert compare(A.op12_source_audit(spark, sf), con, A.ORACLE) is None
