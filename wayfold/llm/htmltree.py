"""Main text of web pages by a tree-structured graphical model (operator 9).

A page is a tree: block elements, and runs of text as leaves.  Every node is content or not.  A node's potential comes
from its features (tag, class and id words; for a run of text its length, share of links and parent), a parent-child
potential from how often states go together.  Sum-product messages upward and downward give each node's marginal, and
the runs of text that are more likely content than not are the main text, in page order.

The potentials are counted on labelled pages: pages made by rule here, each part of which is labelled, and a bounded
hash sample (about `SAMPLE_PAGES`) of the table's own pages that have landmarks, of which features seen `LEAST_SEEN` times stay.

Defined cases: null html counts as empty, whose text is empty; unclosed and stray tags are taken as browsers take them
in the main; raw elements (script, style and the like) hold no text; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_slices

SAMPLE_PAGES, LEAST_SEEN = 2000, 2
#: Features of one node depend on each other, so those other than names count for less; names seen in one state decide nearly alone.
UNNAMED, NAMED_PRIOR = 0.3, 0.02

#: Elements of running text, elements without content, elements whose text is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics ruby rb rt rp rtc button picture source track param embed output meter progress nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg select audio video canvas".split())
#: Those of them whose text goes on to the end of the page where they are not closed; others are empty then.
TO_THE_END = frozenset(("script", "style"))
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Which open elements a start tag ends, up to the element that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LANDMARKS = {"article": 1, "main": 1, "nav": 0, "header": 0, "footer": 0, "aside": 0, "form": 0}

#: What stands behind '<' if it opens or closes an element, and its attributes up to the '>' that ends it.
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*+")
ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*.?true", re.IGNORECASE)
MARK = re.compile(r"data-content=(\d)")
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

Node = tuple[int, str, str, str, float]  # parent, tag ('' for a run of text), attributes, text, share of it in links


def plain(text: str) -> str:
    """Text with references decoded and white space runs as one space."""
    if "&" in text:
        text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)
    return " ".join(text.split())


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of tags, comments and declarations (no name) in page order, in one pass over the page.

    A quote that never ends would take the rest of the page with it; from the first such tag on, tags end at the next '>'.
    A '<' with no '>' behind it is text.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", ""
        elif start > last:
            return
        elif page[start + 1] in "!?":
            at = page.index(">", start) + 1
            yield start, at, "", ""
        elif m := NAME.match(page, start + 1):
            found = ATTRIBUTES.match(page, m.end()) if quoted else None
            quoted = quoted and found is not None
            at = found.end() if found else page.index(">", m.end()) + 1
            yield start, at, m[0].lower(), page[m.end() : at - 1]
        else:
            at = start + 1


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order; the first is the document."""
    nodes: list[Node] = [(-1, "#document", "", "", 0.0)]
    stack, run, at, in_link = [0], [], 0, False
    depths: dict[str, list[int]] = {}  # of the open elements by name
    unclosed: set[str] = set()  # names of raw elements that no end tag closes from here on

    def flush() -> None:
        if run:
            text = plain("".join(x for x, _ in run))
            if text:
                linked, total = sum(len(x) for x, y in run if y), sum(len(x) for x, _ in run)
                nodes.append((stack[-1], "", "", text, linked / total))
            run.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[nodes[stack.pop()][1]].pop()

    lowest = lambda names: max((depths[x][-1] for x in names if depths.get(x)), default=0)
    for start, end, name, attributes in tags(page):
        if start < at:  # inside a raw element
            continue
        if start > at:
            run.append((page[at:start], in_link))
        at = end
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                in_link = False
            elif name not in INLINE and depths.get(name):
                flush()
                close(depths[name][-1])
            continue
        if name in INLINE:
            if name == "a":
                in_link = True
            elif name in ("br", "img", "embed"):
                run.append((" ", False))
            continue
        flush()
        if name in RAW:
            if not attributes.endswith("/") and name not in unclosed:
                ended = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                if ended or name in TO_THE_END:
                    at = ended.end() if ended else len(page)
                else:
                    unclosed.add(name)
            continue
        if nodes[stack[-1]][1] == "p" and name in BLOCKS:
            close(len(stack) - 1)
        if name in ENDS:
            closes, holds = ENDS[name]
            while (depth := lowest(closes)) > lowest(holds):
                close(depth)
                if name != "tr":
                    break
        if name in VOID:
            continue
        nodes.append((stack[-1], name, attributes, "", 0.0))
        if not attributes.endswith("/"):
            depths.setdefault(name, []).append(len(stack))
            stack.append(len(nodes) - 1)
    if at < len(page):
        run.append((page[at:], in_link))
    flush()
    return nodes


def element_features(tag: str, attributes: str) -> list[str]:
    words = {w.lower() for m in NAMES.finditer(attributes) for w in PARTS.findall(m[1] or m[2] or m[3] or "")} if attributes else set()
    return [f"tag {tag}", *sorted(f"word {w}" for w in words), *(["hidden"] if attributes and HIDDEN.search(attributes) else [])]


def features(nodes: list[Node], k: int) -> tuple:
    """What decides a node's potential, as a key."""
    parent, tag, attributes, text, linked = nodes[k]
    return (tag, attributes) if tag else ("", nodes[parent][1], min(10, len(text).bit_length()), round(3 * linked))


def listed(key: tuple) -> list[str]:
    return element_features(*key) if len(key) == 2 else [f"size {key[2]}", f"linked {key[3]}", f"in {key[1]}"]


SHELL = frozenset(("#document", "html", "body"))


def kind(nodes: list[Node], k: int) -> int:
    """Which parent-child table holds: below the shell of the page, element below element, or text below element."""
    return 0 if nodes[nodes[k][0]][1] in SHELL else 1 if nodes[k][1] else 2


def labels(nodes: list[Node], marked: bool) -> list[int] | None:
    """State of each node: by marks, or by landmarks (None if the page has none for content); elements follow most of their text."""
    given: list[int] = [0] * len(nodes)
    seen = False
    for k, (parent, tag, attributes, _, _) in enumerate(nodes):
        own = (int(m[1]) if (m := MARK.search(attributes)) else None) if marked else LANDMARKS.get(tag)
        inherited = given[parent] if parent >= 0 else 0
        given[k] = inherited if own is None else own if marked or not inherited or not own else 1
        seen |= given[k] == 1
    if not seen:
        return None
    weight, total = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if not nodes[k][1]:
            total[k], weight[k] = len(nodes[k][3]), len(nodes[k][3]) * given[k]
        total[nodes[k][0]] += total[k]
        weight[nodes[k][0]] += weight[k]
    return [g if not n[1] or not total[k] else int(2 * weight[k] > total[k]) for k, (g, n) in enumerate(zip(given, nodes))]


def count(page: str, marked: bool) -> Counter:
    """(feature or parent-child state, state) counts of one labelled page."""
    nodes, out = parse(page), Counter()
    states = labels(nodes, marked)
    if states is None:
        return out
    #: pages with landmarks count once more as if those were plain elements, so that pages without them are learned too
    plainly = [(parent, "div" if tag in LANDMARKS else tag, attributes, text, linked) for parent, tag, attributes, text, linked in nodes]
    for seen_as in [nodes] if marked else [nodes, plainly]:
        for k in range(1, len(nodes)):
            tag, attributes = seen_as[k][1], MARK.sub("", nodes[k][2])
            key = (tag, attributes) if tag else features(seen_as, k)
            for f in listed(key):
                out[f, states[k]] += 1
            out["node" if tag else "run", states[k]] += 1
            out[f"pair {kind(nodes, k)} {states[nodes[k][0]]}", states[k]] += 1
    return out


#: Words in classes and ids of the labelled pages: parts that are not the article, and parts that are.
OTHER_PARTS = """ad ads advert advertisement sponsor sponsored promo promotion banner cookie consent notice gdpr popup modal overlay
sidebar side widget related recommended popular trending menu nav navigation navbar breadcrumb breadcrumbs pagination pager
header masthead topbar footer copyright legal share sharing social follow subscribe newsletter signup login search form
comment comments respond reply discussion disqus author bio tags toolbar alert skip contact rating""".split()
ARTICLE_PARTS = "content article post entry main story body text blog page news detail markdown prose".split()


def labelled_pages(seed: int = 7) -> list[str]:
    """Pages made by rule with data-content marks, one for each kind of part and way of wrapping the article."""
    draw, out = random.Random(seed), []
    word = lambda: "".join(draw.choice("aeiou") + draw.choice("lmnrstd") for _ in range(draw.randint(1, 4)))
    text = lambda low, high: " ".join(word() for _ in range(draw.randint(low, high))) + "."
    links = lambda: "<ul>" + "".join(f'<li><a href="#">{word()}</a></li>' for _ in range(draw.randint(3, 8))) + "</ul>"
    for k, part in enumerate(OTHER_PARTS * 4):
        paragraphs = "".join(draw.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<pre>{}</pre>"]).format(text(1, 90)) for _ in range(draw.randint(1, 9)))
        inner = f"<h1>{text(2, 9)}</h1>{paragraphs}"
        aside = draw.choice(["<div class={0}>{1}</div>", "<section id={0}>{1}</section>", "<div class={0}><p>{1}</p></div>", "<aside class={0}>{1}</aside>", "<form class={0}>{1}</form>"]).format(f'"{part} {draw.choice(OTHER_PARTS)}" data-content=0', draw.choice([text(3, 12), text(8, 40), links()]))
        if k % 3 == 0:
            inner += aside
        name = draw.choice(ARTICLE_PARTS)
        wrapped = [f"<article data-content=1>{inner}</article>", f"<main data-content=1>{inner}</main>", f'<div class="{name}" data-content=1>{inner}</div>', f'<div id="{name}"><div class="{draw.choice(ARTICLE_PARTS)}" data-content=1>{inner}</div></div>', f"<div data-content=1>{inner}</div>"][k % 5]
        before = draw.choice([f"<nav data-content=0>{links()}</nav>", f"<header data-content=0><p>{text(2, 8)}</p>{links()}</header>", f'<div class="{draw.choice(("menu", "header", "nav"))}" data-content=0>{links()}</div>'])
        after = draw.choice([f"<footer data-content=0>{text(3, 20)}</footer>", f'<div class="footer" data-content=0><p>{text(3, 20)}</p></div>', f"<aside data-content=0>{links()}</aside>{'<footer data-content=0>' + text(2, 9) + '</footer>'}"])
        out.append(f"<html><body>{before}{aside if k % 3 else ''}{wrapped}{after}</body></html>")
    return out


class Model:
    """Log potentials from counts."""

    def __init__(self, counts: dict[tuple[str, int], int]):
        of = lambda f, s: counts.get((f, s), 0)
        nodes = {"element": [of("node", s) + 1 for s in (0, 1)], "run": [of("run", s) + 1 for s in (0, 1)]}
        self.potential = {}
        for f in {f for f, _ in counts if not f.startswith(("pair ", "node", "run"))}:
            n = nodes["run" if f.startswith(("size ", "linked ", "in ")) else "element"]
            named = f.startswith("word ")
            self.potential[f] = [(1 if named else UNNAMED) * math.log((of(f, s) + (NAMED_PRIOR if named else 0.5)) / (n[s] + 1)) for s in (0, 1)]
        pair = np.array([[[of(f"pair {k} {p}", s) + 0.5 for s in (0, 1)] for p in (0, 1)] for k in range(3)])
        self.pair = np.log(pair / pair.sum(axis=2, keepdims=True))

    def emission(self, key: tuple) -> list[float]:
        found = [self.potential[f] for f in listed(key) if f in self.potential]
        return [sum(x[0] for x in found), sum(x[1] for x in found)]

    def marginals(self, trees: list[list[Node]], known: dict) -> np.ndarray:
        """P(content) of every node of several pages, by sum-product over each tree."""
        parent, depth, table, own = [], [], [], []
        for nodes in trees:
            base, depths = len(parent), []
            for k, node in enumerate(nodes):
                parent.append(base + node[0] if k else -1)
                depths.append(depths[node[0]] + 1 if k else 0)
                table.append(kind(nodes, k) if k else 0)
                own.append(known[features(nodes, k)] if k else (0.0, 0.0))
            depth += depths
        parent, depth, table, up = np.array(parent), np.array(depth), np.array(table), np.array(own)
        own_pair = self.pair[table]  # child, parent's state, own state
        order, message = np.argsort(depth, kind="stable"), np.zeros_like(up)
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        levels = [order[cuts[d] : cuts[d + 1]] for d in range(1, depth.max() + 1)]
        for at in reversed(levels):
            message[at] = np.logaddexp.reduce(own_pair[at] + up[at][:, None, :], axis=2)
            np.add.at(up, parent[at], message[at])
        down = np.zeros_like(up)
        for at in levels:
            above = down[parent[at]] + up[parent[at]] - message[at]
            down[at] = np.logaddexp.reduce(own_pair[at] + above[:, :, None], axis=1)
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))

    def extract(self, pages: list[str], known: dict) -> list[str]:
        trees = [parse(p) for p in pages]
        likely, at, out = self.marginals(trees, known) if trees else [], 0, []
        for nodes in trees:
            out.append("\n".join(n[3] for n, p in zip(nodes, likely[at : at + len(nodes)]) if not n[1] and p > 0.5))
            at += len(nodes)
        return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Potentials from the pages made by rule and a bounded sample of the table's pages with landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sum((count(p, False) for p in batch.column(0).to_pylist()), Counter())
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["feature", "state", "n"])

    usable = pages.filter(F.col(html_col).isNotNull())
    share = min(1.0, SAMPLE_PAGES / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(F.col(html_col).alias("html"))
    #: as many rows as features in a bounded sample
    counted = sample.mapInArrow(run, "feature string, state int, n long").groupBy("feature", "state").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN)
    total = Counter({(r["feature"], r["state"]): r["n"] for r in counted.collect()})
    for page in labelled_pages():
        total.update(count(page, True))
    return Model(total)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(shared.value.emission, 100_000)
        for whole in batches:
            for batch in in_slices([whole], 200):
                texts = shared.value.extract(["" if p is None else p for p in batch.column(2).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")


def op9_tree_model_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
