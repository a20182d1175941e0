"""Main text of web pages: boosted trees over DOM nodes, hierarchical decoding.

1. ``parse`` builds the element tree of a whole page and per node features:
   density and links of the subtree, tokens of tag, class, id and role on the
   node and its ancestors, depth, and what its siblings are like.
2. ``learn`` fits gradient-boosted trees on labelled pages.  The tables hold no
   labels, so pages are composed for it: paragraphs of at most ``SAMPLE_PAGES``
   whole pages of the input, those with the smallest hashes of page_id, in varied
   article markup, with menus, headers, footers, sidebars, notices, adverts, forms
   and reader comments around and inside.  Half of the pages name the article's
   holder in no way (no holder, bare or arbitrarily named ones, layout tables,
   names of other parts), and a share hides the names of the other parts too, so
   the trees have to learn density and siblings and not the names alone.
3. ``decode`` labels the nodes of a page together by dynamic programming: a
   node is outside, inside or cut; inside a cut node all is cut, and a cut can
   only be made inside.  No kept node has a cut ancestor.

Character references are decoded, white space runs become one space, and block
elements and line breaks part words; inline elements do not.

Defined cases: a null or empty page, or one without an article, has an empty
text; broken and unclosed markup is read as browsers do in outline (an open
paragraph ends at the next block, stray end tags are skipped, an unclosed
comment or script runs to the end); repeated rows give a row each; an empty
table gives no row.  Pages are read whole, one at a time.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import read

SAMPLE_PAGES = 200      # pages whose paragraphs the labelled pages are made of
POOL = 4000             # paragraphs of them, at most
LABELLED_PAGES = 1400
TREES = 50
DEPTH = 6
RUN = 256               # pages whose nodes are scored in one call

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(
    r"\b(class|id|role|data-gold)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe select".split())
_FOREIGN = frozenset(("svg", "math"))      # inside, a tag that ends in "/>" has no content
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp "
                    "rt ruby s samp small span strike strong sub sup time tt u var wbr data "
                    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover "
                    "munder munderover mstyle mpadded mphantom menclose semantics".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset "
                    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
                    "ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
         "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",),
          "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}

# Token families of tag, class, id and role; the model decides what they mean.
FAMILIES = {
    "article": "article main content post entry story body text page",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead top banner logo branding",
    "footer": "footer foot bottom copyright colophon contentinfo legal",
    "side": "aside sidebar side rail widget complementary related recommended more trending",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning banner message",
    "form": "form login signup subscribe newsletter search contact input",
    "comments": "comment comments reply replies discussion disqus respond reader readers",
    "share": "share sharing social follow tweet facebook",
}
_FAMILY: dict[str, list[int]] = {}
for _k, _w in enumerate(FAMILIES.values()):
    for _t in _w.split():
        _FAMILY.setdefault(_t, []).append(_k)
_NF = len(FAMILIES)
_TAGS = ("p", "h1 h2 h3 h4 h5 h6", "li", "ul ol dl menu", "div section", "table tr td th tbody",
         "blockquote pre figure figcaption", "body html")
_TAG = {t: k for k, ts in enumerate(_TAGS) for t in ts.split()}
FEATURES = (["depth", "own", "text", "density", "links", "tags", "share", "place", "siblings",
             "alike", "stops", "blocks", "prose_siblings", "self_other", "above_other", "before",
             "up_text", "up_links", "up_share"]
            + [f"tag{k}" for k in range(len(_TAGS))]
            + [f"self_{f}" for f in FAMILIES] + [f"above_{f}" for f in FAMILIES])


class Page:
    """Nodes in page order and the texts between tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.family, self.gold = [], [], [], []
        self.begin, self.end = [], []
        self.parts: list[tuple[int, str | None, bool]] = []   # node, text (None: break), in a link
        self._read(source)

    def _open(self, tag: str, parent: int, attrs: str, at: int) -> int:
        mask, gold = 0, None
        tokens = [] if tag in ("html", "body") else [tag]
        if attrs:
            for m in _ATTRIBUTE.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-gold":
                    gold = int(value)
                else:
                    tokens += _SPLIT.split(_CAMEL.sub(" ", value).lower())
        for t in tokens:
            for k in _FAMILY.get(t, ()):
                mask |= 1 << k
        self.tag.append(tag)
        self.parent.append(parent)
        self.family.append(mask)
        self.gold.append(gold if gold is not None or parent < 0 else self.gold[parent])
        self.begin.append(at)
        self.end.append(at)
        return len(self.tag) - 1

    def _read(self, s: str) -> None:
        root = self._open("html", -1, "", 0)
        stack: list[tuple[str, int]] = [("html", root)]      # tag, node (inline: that of its block)
        links = foreign = 0                                  # foreign: place of svg or math
        at, pos, size = 0, 0, len(s)
        parts = self.parts
        in_head = False
        while pos < size:
            m = _TOKEN.search(s, pos)
            stop = m.start() if m else size
            if stop > at and not in_head:
                parts.append((stack[-1][1], s[at:stop], links > 0))
            if not m:
                break
            pos = at = m.end()
            token = m.group()
            name = _NAME.match(token)
            if not name:
                continue
            tag = name[1].lower()
            if token[1] == "/":
                if tag == "head":
                    in_head = False
                    continue
                k = len(stack) - 1
                while k > 0 and stack[k][0] != tag:
                    if tag in _INLINE and stack[k][0] not in _INLINE:
                        k = 0
                        break
                    k -= 1
                if k > 0:
                    links -= self._close(stack, k, stop)
                continue
            if tag == "head":
                in_head = True
                continue
            if tag == "body":
                in_head = False
            inside = foreign and foreign < len(stack) and stack[foreign][0] in _FOREIGN
            if tag in _RAW and inside and token.endswith("/>"):
                continue
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(s, pos)
                pos = at = close.end() if close else size
                parts.append((stack[-1][1], None, False))
                continue
            if in_head:
                if tag in ("meta", "link", "base", "noscript"):
                    continue
                in_head = False
            if tag in _VOID:
                if tag not in ("wbr", "img"):
                    parts.append((stack[-1][1], None, False))
                continue
            if tag in _ENDS_P or tag in _SAME:
                ends = _SAME.get(tag, ("p",))
                holds = _HOLDS.get(tag, ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends or (tag in _SAME and stack[k][0] == "p"):
                        links -= self._close(stack, k, stop)
                        if tag not in _SAME:
                            break
                    elif stack[k][0] in holds or not (
                            tag in _SAME or stack[k][0] in _INLINE):
                        break
            attrs = token[len(name.group()):]
            if tag in _INLINE and "class" not in attrs and "id=" not in attrs:
                stack.append((tag, stack[-1][1]))
            else:
                if tag not in _INLINE:
                    parts.append((stack[-1][1], None, False))
                if tag in ("html", "body") and any(t == tag for t, _ in stack):
                    continue
                stack.append((tag, self._open(tag, stack[-1][1], attrs, stop)))
            if tag in _FOREIGN and not inside:
                inside, foreign = True, len(stack) - 1
            links += tag == "a"
            if token.endswith("/>") and (tag in _INLINE or inside):
                links -= self._close(stack, len(stack) - 1, stop)
        self._close(stack, 0, size)

    def _close(self, stack, k: int, at: int) -> int:
        """Close the stack from k on; the number of links closed."""
        links = 0
        for tag, node in reversed(stack[k:]):
            links += tag == "a"
            if tag not in _INLINE:
                self.parts.append((node, None, False))
            if self.tag[node] == tag:
                self.end[node] = at
        del stack[k:]
        return links

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, text, linked, stops, tags, blocks = ([0] * n for _ in range(6))
        for node, t, link in self.parts:
            if t is None:
                continue
            c = len(t.strip())
            if c:
                own[node] += c
                text[node] += c
                linked[node] += c if link else 0
                stops[node] += t.count(". ") + t.count(", ") + t.endswith(".")
                blocks[node] += 1
        parent, family = self.parent, self.family
        children = [0] * n
        prose = [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            tags[p] += tags[i] + 1
            blocks[p] += blocks[i]
            children[p] += 1
            prose[p] += self.tag[i] == "p" and own[i] > 40
        seen = [0] * n
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            alike[parent[i], self.tag[i]] = alike.get((parent[i], self.tag[i]), 0) + 1
        depth, above = [0] * n, [0] * n
        log = math.log1p
        total = text[0] or 1
        before = self._before(own)
        out = []
        for i in range(n):
            p = parent[i]
            if p >= 0:
                depth[i] = depth[p] + 1
                above[i] = above[p] | family[p]
                seen[p] += 1
                place, many = seen[p] / children[p], children[p]
                same, side = alike[p, self.tag[i]] / many, prose[p]
            else:
                place, many, same, side = 1.0, 1, 1.0, 0
            c = text[i]
            row = [depth[i], log(own[i]), log(c), c / (self.end[i] - self.begin[i] + 1),
                   linked[i] / c if c else 0.0, log(tags[i]), c / total, place, log(many), same,
                   100.0 * stops[i] / (c + 1), log(blocks[i]), log(side),
                   (family[i] >> 1).bit_count(), (above[i] >> 1).bit_count(), before[i] / total,
                   log(text[max(p, 0)]), linked[p] / text[p] if p >= 0 and text[p] else 0.0, c / (text[max(p, 0)] or 1)]
            kind = _TAG.get(self.tag[i], -1)
            row += [1.0 if k == kind else 0.0 for k in range(len(_TAGS))]
            row += [float(family[i] >> k & 1) for k in range(_NF)]
            row += [float(above[i] >> k & 1) for k in range(_NF)]
            out.append(row)
        self.own = own
        return np.array(out)

    def _before(self, own: list[int]) -> list[int]:
        """Characters of text before each node opens (nodes are in page order)."""
        out, total = [0] * len(own), 0
        for i, c in enumerate(own):
            out[i] = total
            total += c
        return out

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Which nodes are inside, by the best consistent labelling."""
        n = len(self.tag)
        weight = [0.2 + math.log1p(c) for c in self.own]
        odds = np.clip(odds, -12, 12)
        yes = (-np.log1p(np.exp(-odds)) * weight).tolist()
        no = (-np.log1p(np.exp(odds)) * weight).tolist()
        inside, cut, outside = yes[:], no[:], no[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            inside[p] += max(inside[i], cut[i])
            cut[p] += cut[i]
            outside[p] += max(outside[i], inside[i])
        state = [0] * n                      # 0 outside, 1 inside, 2 cut
        state[0] = int(inside[0] > outside[0])
        for i in range(1, n):
            up = state[self.parent[i]]
            if up == 2:
                state[i] = 2
            elif up == 1:
                state[i] = 1 if inside[i] >= cut[i] else 2
            else:
                state[i] = int(inside[i] > outside[i])
        return [x == 1 for x in state]

    def text(self, keep: list[bool]) -> str:
        out = []
        for node, t, _ in self.parts:
            if t is None:
                out.append(" ")
            elif keep[node]:
                out.append(html.unescape(t))
        return " ".join("".join(out).split())


class Trees:
    """Boosted trees as arrays; ``odds`` are log odds of being main text."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            feature, threshold, left, right, value = [], [], [], [], []

            def walk(node):
                i = len(feature)
                for c in (feature, threshold, left, right, value):
                    c.append(0)
                if node.subtreeDepth() == 0:
                    left[i] = right[i] = i
                    value[i] = 2.0 * weight * node.prediction()
                else:
                    feature[i], threshold[i] = node.split().featureIndex(), node.split().threshold()
                    left[i] = walk(node.leftChild())
                    right[i] = walk(node.rightChild())
                return i

            walk(tree._call_java("rootNode"))
            self.trees.append(tuple(np.array(c) for c in (feature, threshold, left, right, value)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return total


def paragraphs(source: str) -> list[str]:
    """The longer paragraphs of a page, whatever part of it they are in."""
    page = Page(source)
    nodes: dict[int, list[str]] = {}
    for node, t, _ in page.parts:
        if t and page.tag[node] in ("p", "td", "div", "blockquote"):
            nodes.setdefault(node, []).append(html.unescape(t))
    return [x for x in (" ".join(" ".join(v).split()) for v in nodes.values()) if len(x) > 20]


def pool_of(pages: DataFrame, sample: int = SAMPLE_PAGES, size: int = POOL) -> list[str]:
    """Paragraphs to compose pages of, in runs of at most 300 words (a "word" of over 100
    characters is none): those of ``sample`` whole pages, picked and thinned by hashes,
    so neither the order nor the layout of the table counts."""

    def run(batches):
        for b in batches:
            found = [" ".join(w[i:i + 300]) for t in b.column(0) for x in paragraphs(t.as_py() or "")
                     for w in [[v for v in x.split() if len(v) <= 100]] for i in range(0, len(w), 300)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["text"])

    # Only a few times ``sample`` pages leave the scan, whatever the size of the table;
    # repeated pages have one hash and are one page.
    key = F.xxhash64(F.lit("pool"), "page_id", "html").bitwiseAND(F.lit(2**63 - 1))
    top = min(2**63 - 1, (2**63 - 1) * 8 * sample // max(1, pages.count()))
    few = pages.select("html", key.alias("key")).where(F.col("key") <= F.lit(top))
    some = few.dropDuplicates(["key"]).orderBy("key").limit(sample).select("html")
    texts = some.mapInArrow(run, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(size)
    return [r.text for r in texts.collect()] or [
        "The harbour was quiet in the morning, and the boats lay still. Later the wind rose from the west."]


def compose(rng: random.Random, pool: list[str]) -> str:
    """One labelled page: data-gold is 1 on the article and 0 on other parts."""
    pick, esc = rng.choice, html.escape

    def prose():
        words = pick(pool).split()
        size = min(len(words), max(3, int(rng.lognormvariate(3.4, 1.0))))
        a = rng.randrange(max(1, len(words) - size + 1))
        words = words[a : a + size]
        odd = rng.random()
        if odd < 0.08:                       # plain runs of words, lists, repeats
            words = [w.strip(".,") for w in words]
        elif odd < 0.13:
            words = [words[0]] * rng.randint(5, 200)
        return esc(" ".join(words))

    def few(n=3):
        return esc(" ".join(pick(pool).split()[: rng.randint(1, n)]))

    def links(n):
        return "".join(f'<li><a href="/{k}">{few()}</a></li>' for k in range(n))

    def tag(name, inner, words=None, gold=None):
        a = f' data-gold="{gold}"' if gold is not None else ""
        if words:
            a += f' {pick(["class", "class", "id"])}="{words}"'
        return f"<{name}{a}>{inner}</{name}>"

    hidden = rng.random() < 0.3              # parts that their structure tells apart have no names

    def odd_name():
        return pick(["x1", "c-12", "u_7f", "inner", "outer", "wrap", "wrapper", "container", "row", "col", "col-8", "box",
                     "b2", "grid", "center", "layout", "cell", "block", "node", "".join(rng.choices("abcdefghijklmnop", k=6))])

    def some(family):
        if hidden and family in ("menu", "header", "footer", "form"):
            return pick([None, odd_name()])
        w = pick(FAMILIES[family].split())
        return pick([w, w, f"{w}-{pick(['box', 'wrap', 'list', 'area', '1'])}", f"site-{w}"])

    def block(kind):
        if kind == "menu":
            inner = f"<ul>{links(rng.randint(2, 8))}</ul>"
            if rng.random() < 0.2:
                inner = " | ".join(f'<a href="/{k}">{few()}</a>' for k in range(rng.randint(2, 7)))
            kinds = [("div", inner, some(kind)), ("ul", links(5), some(kind))] + [("nav", inner)] * (not hidden)
            return tag(*pick(kinds), gold=0)
        if kind == "header":
            inner = pick([f"<h1>{few(5)}</h1>", f"<a href='/'>{few()}</a> {few(6)}", f"<p>{prose()}</p>"])
            if hidden:
                inner = f"<a href='/'>{few()}</a> " + few(3) * rng.randint(0, 1)
            return tag(*pick([("header", inner)] * (not hidden) + [("div", inner, some(kind))]), gold=0)
        if kind == "footer":
            inner = pick(["&copy; ", ""]) + pick([prose(), f"<p>{prose()}</p>", f"<ul>{links(3)}</ul>{few(9)}"])
            named = [("footer", inner), ("footer", inner, some(kind))] * (not hidden)
            if hidden:
                inner = "&copy; " + few(9)
            return tag(*pick(named + [("div", inner, some(kind))]), gold=0)
        if kind == "side":
            inner = pick([f"<h3>{few()}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p><p>{prose()}</p>", prose()])
            return tag(*pick([("aside", inner), ("aside", inner, some(kind)), ("div", inner, some(kind))]), gold=0)
        if kind == "comments":
            one = lambda: tag(pick(["div", "p", "li"]), pick(["", f"<b>{few(2)}</b> "])
                              + pick([prose(), f"<p>{prose()}</p>"]), pick([None, "comment", "reply"]))
            inner = f"<h3>{few()}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 6)))
            return tag(pick(["section", "div", "ol", "aside"]), inner, some(kind), gold=0)
        if kind == "form":
            inner = f"<label>{few()}</label><input name=q>{prose()}<button>{few(1)}</button>"
            return pick([tag("form", inner, gold=0), tag("div", f"<form>{inner}</form>", some(kind), gold=0)])
        inner = pick([prose(), f"<p>{prose()}</p>", f'<a href="/x">{few(8)}</a>', f"<h4>{few()}</h4><p>{prose()}</p>"])
        name = pick(["div", "div", "section", "aside", "p"])
        if name == "p":                      # a paragraph holds no blocks
            inner = pick([prose(), f'<a href="/x">{few(8)}</a>'])
        return tag(name, inner, some(kind), gold=0)

    kinds = list(FAMILIES)[1:]
    body = []
    for k in range(pick([1, 1, 2, 4, 8, 15, 30])):
        body.append(pick([lambda: f"<p>{prose()}</p>"] * 12 + [
            lambda: f"<p><b>{prose()}<br>", lambda: f"<h2>{few(6)}</h2>",
            lambda: f"<ul>{''.join(f'<li>{prose()}</li>' for _ in range(3))}</ul>",
            lambda: f"<blockquote>{prose()}</blockquote>", lambda: f"<div>{prose()}</div>",
            lambda: f"<p>{few(5)} <a href='/y'>{few()}</a> {prose()}</p>",
            lambda: f"<table><tr><td>{few()}</td><td>{few()}</td></tr></table>",
            lambda: f"<figure><figcaption>{few(9)}</figcaption></figure>", lambda: f"<pre>{prose()}</pre>"])())
        if rng.random() < 0.06:
            body.append(block(pick(kinds)))
    if rng.random() < 0.3:
        body.append(block(pick(["comments", "share", "side", "footer", "form"])))
    if rng.random() < 0.04:                  # one short paragraph over and over
        body += [f"<p>{few(3)}.</p>"] * rng.randint(3, 80)
    pieces = [f"<h1>{few(9)}</h1>"] * (rng.random() < 0.8) + body
    before = [block(pick(["menu", "menu", "header", "advert", "notice", "form", "side", "share"]))
              for _ in range(rng.randint(0, 4))]
    after = [block(pick(["comments", "comments", "footer", "footer", "side", "advert", "form", "share", "menu"]))
             for _ in range(rng.randint(0, 4))]
    article = "".join(pieces)
    if rng.random() < 0.5:
        holder = pick(["article", "article", "article", "main", "div", "section"])
        words = pick(FAMILIES["article"].split()) if holder in ("div", "section") else \
            pick([None, None, pick(FAMILIES["article"].split())])
        article = tag(holder, article, words, gold=1)
    else:
        kind = rng.random()
        if kind < 0.3:                       # no holder: the pieces stand among the other parts
            article = "".join(re.sub(r"^<([a-z0-9]+)(?=[ >])(?! data-gold)", r'<\1 data-gold="1"', x) for x in pieces)
        elif kind < 0.45:                    # a layout table
            cells = ([tag("td", "".join(before), gold=0)] * bool(before) + [tag("td", article, pick([None, odd_name()]), gold=1)]
                     + [tag("td", "".join(after), gold=0)] * (bool(after) and rng.random() < 0.5))
            if len(cells) < 2 + bool(before):
                after = []
            before, article = [], f"<table><tr>{''.join(cells)}</tr></table>"
        elif kind < 0.93:
            article = tag(pick(["div", "div", "div", "section"]), article, pick([None, odd_name(), odd_name()]), gold=1)
            for _ in range(pick([0, 0, 1, 2])):
                article = tag("div", article, pick([None, odd_name()]))
        else:                                # a name of another part
            article = tag("div", article, pick(FAMILIES[pick(["header", "side", "notice", "share", "menu"])].split()), gold=1)
    inner = "".join(before) + article + "".join(after)
    for _ in range(rng.randint(0, 2)):
        inner = tag("div", inner, pick(["wrap", "container", "page", "site", None, odd_name()]))
    return (f"<!DOCTYPE html><html><head><title>{few(6)}</title><style>p{{}}</style></head><body>"
            f"{inner}</body></html>")


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES, labelled: int = LABELLED_PAGES) -> Trees:
    """Fit on pages composed of the paragraphs of ``sample`` whole pages at most."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    spark = pages.sparkSession
    pool = pool_of(pages, sample)
    rng = random.Random(5)
    rows = []
    for _ in range(labelled):
        page = Page(compose(rng, pool))
        for x, gold in zip(page.features().tolist(), page.gold):
            rows.append((Vectors.dense(x), float(gold or 0)))
    train = spark.createDataFrame(rows, ["features", "label"])
    fit = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3).fit(train.coalesce(4))
    return Trees(fit)


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url, text."""

    def run(batches):
        for b in batches:
            source, texts = b.column(2), []
            for i in range(0, b.num_rows, RUN):
                parsed = [Page(source[k].as_py() or "") for k in range(i, min(i + RUN, b.num_rows))]
                x = [p.features() for p in parsed]
                odds = model.odds(np.concatenate(x))
                at = 0
                for p, f in zip(parsed, x):
                    texts.append(p.text(p.decode(odds[at : at + len(f)])))
                    at += len(f)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    out = extract(pages, learn(pages))
    return out.withColumn("n_chars", F.length("text").cast("long"))
