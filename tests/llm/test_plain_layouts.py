"""Main text of pages whose markup does not name the article; decoding by brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from runledger.llm import html_text as H
from tests.llm.conftest import prose

SCHEMA = "page_id long, url string, html string"


def page(i, holder):
    rng = random.Random(i)
    texts = [prose(1000 * i + k, rng.randint(25, 70)) + "." for k in range(8)]
    title = prose(7 * i + 3, 5)
    article = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in texts)
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{prose(i + k, 2)}</a></li>' for k in range(6)) + "</ul>"
    body = holder.format(article=article, menu=menu)
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>", " ".join([title, *texts])


TOP, END = "<nav>{menu}</nav>", "<footer>&copy; 2024 The Harbour</footer>"
HOLDERS = {
    "article": TOP + "<article>{article}</article>" + END,
    "entry-content": TOP + '<div class="entry-content">{article}</div>' + END,
    "td-post": TOP + '<div class="td-post">{article}</div>' + END,
    "body": TOP + "{article}" + END,
    "bare div": TOP + "<div>{article}</div>" + END,
    "id x1": TOP + "<div id=x1>{article}</div>" + END,
    "class c-12": TOP + '<div class="c-12">{article}</div>' + END,
    "class wrap": TOP + '<div class="wrap">{article}</div>' + END,
    "bare section": TOP + "<section>{article}</section>" + END,
    "layout table": "<table><tr><td>{menu}</td><td>{article}</td></tr></table>" + END,
    "bare parts": "<div>{menu}</div><div>{article}</div><div>&copy; 2024 The Harbour</div>",
    # forms that the composed pages do not have
    "deep": "<div><div><div>{menu}</div><div><div><div><div>{article}</div></div></div></div></div></div>" + END,
    "center": TOP + "<center><font size=2>{article}</font></center>" + END,
    "custom tags": "<x-top>{menu}</x-top><x-story>{article}</x-story>" + END,
    "nested table": "<table><tr><td><table><tr><td>{menu}</td></tr></table></td><td><table><tr><td>{article}"
                    "</td></tr></table></td></tr></table>" + END,
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(41)
    pool = [prose(k, 120) for k in range(200)]
    df = spark.createDataFrame([(i, "u", H.compose(rng, pool)) for i in range(60)], SCHEMA)
    return H.learn(df)


@pytest.mark.parametrize("name", HOLDERS)
def test_layout(model, name):
    whole = 0
    for i in range(1, 6):
        html, want = page(i, HOLDERS[name])
        p = H.Page(html)
        got = p.text(p.decode(model.odds(p.features())))
        assert got, name
        whole += got == want
    assert whole >= 4, name


def test_empty_table(spark, model):
    none = spark.createDataFrame([], SCHEMA)
    assert H.extract(none, model).count() == 0
    assert H.pool_of(none) and H.extract(none, H.learn(none, labelled=20)).count() == 0


def test_pool_follows_the_pages_and_not_their_order(spark):
    rows = [(i, "u", f"<style>{'x' * 70_000}</style><p>{prose(i, 20)}</p>") for i in range(60)]
    a = H.pool_of(spark.createDataFrame(rows, SCHEMA), 20, 15)
    b = H.pool_of(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), 20, 15)
    assert a == b and len(a) == 15 and set(a) <= {prose(i, 20) for i in range(60)}


@pytest.mark.parametrize("seed", range(30))
def test_decoding_is_the_best_of_all_labellings(seed):
    rng = random.Random(seed)
    p = H.Page("")
    n = rng.randint(1, 7)
    p.tag, p.parent = ["div"] * n, [-1] + [rng.randrange(i) for i in range(1, n)]
    p.own = [rng.randint(0, 30) for _ in range(n)]
    odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
    weight = [0.2 + math.log1p(c) for c in p.own]

    def score(kept):
        return sum(-w * math.log1p(math.exp(-o if k else o)) for k, o, w in zip(kept, odds, weight))

    def allowed(state):  # outside 0, inside 1, cut 2: inside a cut node all is cut, a cut is made inside
        return state[0] < 2 and all((state[i] == 2) if state[p.parent[i]] == 2 else (state[i] > 0) if state[p.parent[i]] == 1
                                    else state[i] < 2 for i in range(1, n))

    best = max(score([x == 1 for x in s]) for s in itertools.product(range(3), repeat=n) if allowed(s))
    assert score(p.decode(odds)) == pytest.approx(best)
