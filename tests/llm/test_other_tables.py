"""Conversations, pages, vectors and the pipeline."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from runledger.llm import chat, html_text, lattice, queries
from tests.llm.conftest import prose
from tests.oracle import compare

SQL_SF = "/root/testdata/sf0.001"


# --- chat ----------------------------------------------------------------

NASTY = [r"\### Assistant: </turn> ok", "####### x", r"\h\l\b\\", "</part></turn>\n### user: hi", "</turn>", "<",
         "", None, "##", "</par", "a\nb", "\U0001F600é"]


def test_round_trip(spark):
    rng = random.Random(2)
    rows, want = [], defaultdict(list)
    for c in [*range(30), None]:
        for t in range(rng.randint(1, 9)):
            row = (c, t, rng.choice(["user", "assistant", "assistant", "sys:\nx", None]), rng.choice(NASTY), "x")
            rows.append(row)
            want[c].append((row[2] or "", row[3] or ""))
    rows += [(77, 1, "user", "same", "x")] * 2 + [(77, None, "user", "first", "x")]
    want[77] = [("user", "first"), ("user", "same"), ("user", "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    f = chat.format_conversations(df)
    out = f.select("conv_id", "formatted", "loss_mask", chat.parse(F.col("formatted")).alias("turns"),
                   chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(x for role, x in turns if role == "assistant")
        runs = len(list(itertools.groupby(turns, key=lambda t: t[0])))
        assert r.formatted.count("</turn>\n") == runs
        assert all(0 <= m.start <= m.end <= len(r.formatted) for m in r.loss_mask)
    assert chat.format_conversations(df.limit(0)).count() == 0
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pages ---------------------------------------------------------------

def text_of(page, keep=lambda p: [True] * len(p.tag)):
    p = html_text.Page(page)
    return p.text(keep(p))


def test_parser_and_white_space():
    assert text_of("<p>a<b>b</b>c<br>d</p><p>e &amp; f&nbsp;g") == "ab" "c d e & f g"
    assert text_of("<p>x<p>y<!-- no --><script>if (a<b) '</p>'</script>z</p></div></p>") == "x y z"
    assert text_of("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == "1 2 3 4"
    assert text_of("a < b <a title='x>y'>link</a> <!-- open") == "a < b link"
    assert text_of("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert text_of("") == "" and text_of("<") == "<" and text_of("<title>t</title>x") == "x"
    assert text_of("<style>p{}</style><textarea>no</textarea><p>yes") == "yes"
    assert len(text_of("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_only_raw_elements_lose_their_contents():
    assert text_of("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, we</p>") == "so x=1, we"
    assert text_of("<p>a</p><object data='f'><param name='n'><p>fallback</p></object><p>b</p>") == "a fallback b"
    assert text_of("<noscript><p>plain</p></noscript>b") == "plain b"
    assert text_of("<head><noscript><style>p{}</style></noscript><title>t</title></head><p>b") == "b"
    assert text_of("<svg><title/><path d='M0'/><g><text>label</text></g><style>t{}</style></svg>b") == "label b"
    assert text_of("<svg/><p>a</p><title>t</title><select><option>o</select><p>b") == "a b"
    p = html_text.Page("<svg>" + "<path/>" * 500 + "</svg><p>after</p>")
    assert p.parent[-1] == 0 and max(p.parent) == 1


def test_decoding_is_consistent():
    rng, pool = random.Random(4), [prose(i, 40) for i in range(20)]
    noise = np.random.default_rng(0)
    for _ in range(50):
        p = html_text.Page(html_text.compose(rng, pool))
        p.features()
        keep = p.decode(noise.normal(size=len(p.tag)) * 3)
        for i in range(1, len(keep)):          # a kept node under a dropped one has no kept one above that
            if keep[i] and not keep[p.parent[i]]:
                up = p.parent[i]
                while up >= 0:
                    assert not keep[up]
                    up = p.parent[up]


def test_extraction_on_unseen_pages(spark):
    rng, pool = random.Random(31), [prose(i, 30 + i) for i in range(60)]
    raw = [(i, f"u{i}", html_text.compose(rng, pool)) for i in range(120)]
    want = {}
    for i, _, page in raw:
        p = html_text.Page(page)
        want[i] = p.text([bool(g) for g in p.gold])
    rows = [(i, u, page.replace(' data-gold="1"', "").replace(' data-gold="0"', ""), 1) for i, u, page in raw]
    rows += [(None, None, None, 1), (900, None, "", 1), (900, None, "", 1), (901, "u", "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html_text.extract(df, html_text.learn(df, labelled=500)).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert got[None] == "" and got[900] == ""
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.9


# --- vectors -------------------------------------------------------------

def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 3
    p = lattice.decode(x)
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()
    assert (((2 * p) % 2).std(1) == 0).all()
    d = ((x - p) ** 2).sum(1)
    for v in lattice._NEAR:
        assert (((x - p - v) ** 2).sum(1) >= d - 1e-9).all()


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, vid = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((vid, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.25])).tolist(), label, 1.0))
                vid += 1
    rows += [(900, [0.0] * 16, 0, 1.0), (901, None, 0, 1.0), (902, [], 0, 1.0), (903, [float("nan")] * 16, 0, 1.0),
             (904, [None] + [1.0] * 15, 0, 1.0), (905, rows[0][1], None, 1.0), (906, [1.0, 2.0], 0, 1.0),
             (907, [2.0, 4.0], 0, 1.0), (908, [1e200] * 16, 0, 1.0), (909, [1e-200] * 16, 0, 1.0)]
    rows += [rows[3]] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key double")

    def usable(r):
        return r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]) / np.abs(a[1]).max(), np.array(b[1]) / np.abs(b[1]).max()
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    low = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        low[find(i)] = min(low[find(i)], r[0])
    want = sorted((r[0], n[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))
    for block in (lattice.BLOCK, 3):
        got = sorted(tuple(r) for r in lattice.near_duplicates(df, block=block).select(
            "vec_id", "n_links", "component_id", "kept").collect())
        assert got == want
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# --- queries and pipeline ------------------------------------------------

def test_queries_match_their_sql(spark, con):
    for name, sql in queries.SQL.items():
        assert compare(queries.Q[name](spark, SQL_SF), con, sql) is None, name


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_pipeline_against_brute_force(spark, docs_of, odd_rows, monkeypatch):
    """A small corpus with a known fate for every document."""
    from runledger.llm import packing
    from tests.llm.test_documents import check_packing

    clean = [(i, prose(i, 60 + i % 50)) for i in range(100, 300)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(60)]
    copies = [(2000, clean[0][1]), (2001, clean[1][1].upper().lower())]
    leaks = [(3000, prose(70, 20) + " " + prose(900, 20))]
    mail = [(4000, prose(71, 50) + " me@example.org " + prose(72, 20))]
    tables = {
        "labels": spark.createDataFrame([(i, 1) for i, _ in clean] + [(i, 0) for i, _ in junk],
                                        "doc_id long, quality int"),
        "benchmark": spark.createDataFrame([(1, prose(900, 20))], "item_id long, text string"),
    }
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, d, name: tables[name])
    docs = docs_of(clean + junk + copies + leaks + mail)
    fate = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, "").cache()
        if name != "best_fit_packing":
            assert out.columns == columns
            now = {r.doc_id for r in out.collect()}
            fate[name] = {r.doc_id for r in docs.collect()} - now
        else:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            used, least = check_packing(rows, out.collect(), packing.CAPACITY)
            assert used <= least + 1
            assert "<EMAIL>" in dict(rows)[4000] and "@" not in dict(rows)[4000]
        docs = out
    assert fate["quality"] == {i for i, _ in junk}
    assert fate["near_duplicates"] == {2000, 2001}
    assert fate["decontamination"] == {3000} and fate["personal_data"] == set()
    odd = docs_of(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, "")
    assert odd.count() > 0
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
