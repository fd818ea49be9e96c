"""Main text of HTML pages by boosted trees over DOM nodes.

A page is parsed into block-level nodes. Each node has features of its subtree
(text, links, tags, marks), its attribute tokens and those of its ancestors, its
depth, and its place among its siblings. A gradient-boosted classifier gives each
node the odds of being main text. Decoding goes over the tree and takes the states
(main, mixed container, other) with the highest sum of log-odds, weighted by text,
in which no main text lies under other text.

The classifier is fitted on about ``train_pages`` labelled pages chosen by hash,
or on all where there are fewer, however rare they are in the table. Their labels come from their own article or main element; each is also laid out anew
in other frames (plain containers, sidebars, notices, forms, reader comments,
adverts, inside and around the text) whose labels are known.

Defined results: a null or empty page, and one without text, give an empty text;
a very long page is read whole, in time in proportion to its length; sums equal in
decoding are settled as ``Page.decode`` says;
end tags may be missing; a page cut short is read as far as it goes; repeated
rows are extracted each; without a labelled page nothing is fitted and every
block outside navigation elements is kept; other columns are ignored.
"""

from __future__ import annotations

import html as entities

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playframe.llm.common import Scratch, batch_of

START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
LEFT = re.compile(r"<!--|<!\[CDATA\[")  # what may start where no ">" follows
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CUT = re.compile(r"<[/!?a-zA-Z][^>]*\Z")  # a tag that the end of the page cuts
TIE = 1e-9  # sums no further apart are equal
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

MARKED = r"(?i)<(?:article|main)"  # in every page with labels

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea select option svg math object title head".split())
CLOSED_RAW = frozenset("script style textarea title".split())  # hold text only up to their end tag
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"button", "label", "legend", "body", "html"}
LIST = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}),
        "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}

TAGS = {t: i for i, group in enumerate((
    "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "div", "section", "article main", "nav menu", "header", "footer", "aside",
    "form fieldset label legend button", "table tbody thead tfoot tr td th", "blockquote pre", "ul ol dl", "figure figcaption"))
    for t in group.split()}
N_TAGS = 15
GROUPS = (
    "article articlebody content entry main post story text body page",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "header masthead topbar head logo branding",
    "footer foot copyright legal colophon imprint",
    "sidebar side aside widget rail column secondary",
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion outbrain taboola",
    "cookie cookies consent gdpr notice alert popup modal overlay dialog warning announcement disclaimer",
    "comment comments reply replies respond discussion disqus feedback thread reviews",
    "form subscribe newsletter signup login search contact register",
    "share social related recommended recommendations more tags tag popular trending follow",
)
GROUP_OF = {w: i for i, g in enumerate(GROUPS) for w in g.split()}
NEGATIVE_TAGS = frozenset("nav menu footer aside form header button label fieldset".split())


@dataclass(frozen=True)
class Extract:
    train_pages: int = 200
    layouts: int = 3
    trees: int = 20
    depth: int = 5


class Tags:
    """Where the tags of a source end: at the first ">" outside quotes, or at
    the first of all where quotes leave none. One pass over the source, so the
    tags of a page take time in proportion to its length."""

    def __init__(self, source: str):
        self.at = [m.start() for m in SPECIAL.finditer(source)]
        self.k, n = 0, len(self.at)
        self.quoted, self.plain = [-1] * (n + 1), [-1] * (n + 1)
        after = {'"': n, "'": n}
        for k in range(n - 1, -1, -1):
            c = source[self.at[k]]
            if c == ">":
                self.quoted[k] = self.plain[k] = self.at[k]
                continue
            self.plain[k] = self.plain[k + 1]
            if after[c] < n:
                self.quoted[k] = self.quoted[after[c] + 1]
            after[c] = k

    def end(self, start: int, quotes: bool = True) -> int:
        """Place of the ">" of a tag whose name ends at ``start``, -1 if none;
        starts only grow."""
        while self.k < len(self.at) and self.at[self.k] < start:
            self.k += 1
        found = self.quoted[self.k] if quotes else -1
        return found if found >= 0 else self.plain[self.k]


class Page:
    """Block nodes in page order: parent, tag, attribute groups, and the text
    runs, each with the node it lies in."""

    __slots__ = ("parent", "tag", "groups", "gold", "runs", "links", "inner")

    def __init__(self, source: str, framed: bool = False):
        """``framed`` pages are made here and carry their labels in data-gold."""
        self.parent, self.tag, self.groups, self.gold = [-1], ["html"], [0], [None]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.inner = [0]                            # inline elements in each node
        stack: list[tuple[str, int]] = []
        open_at: dict[str, list[int]] = {}          # places of the open elements in the stack, by name
        run: list[str] = []
        linked, in_link, at, end = 0, 0, 0, len(source)
        tags, search, unclosed = Tags(source), START.search, set()

        def flush(node: int) -> None:
            nonlocal run, linked
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.runs.append((node, text, min(linked, len(text))))
            run, linked = [], 0

        def push(name: str, node: int) -> None:
            open_at.setdefault(name, []).append(len(stack))
            stack.append((name, node))

        def cut(k: int) -> None:
            for t, _ in stack[k:]:
                open_at[t].pop()
            del stack[k:]

        def last(names) -> int:
            return max((open_at[t][-1] for t in names if open_at.get(t)), default=-1)

        push("html", 0)
        while at < end:
            m, begin = search(source, at), at
            while m:
                mark, name = m.group(), m.group(2) if m.re is START else None
                if mark in ("<!--", "<![CDATA["):
                    close = "-->" if mark == "<!--" else "]]>"
                    stop = source.find(close, m.end())
                    at = end if stop < 0 else stop + 3
                    break
                stop = tags.end(m.end(), quotes=bool(name))
                if stop >= 0:
                    at = stop + 1
                    break
                search = LEFT.search  # no tag ends any more
                m = search(source, m.start() + 1)
            stop = m.start() if m else end
            if stop > begin:
                piece = source[begin:stop] if m else CUT.sub("", source[begin:stop])
                run.append(piece)
                if in_link:
                    linked += len(piece.strip())
            if not m:
                break
            if not name:
                continue
            closing, rest = m.group(1), source[m.end():at - 1]
            name = name.lower()
            if name == "br":
                run.append(" ")
                continue
            if closing:
                k = last((name,))
                if k > 0:
                    if any(t in BLOCK for t, _ in stack[k:]):
                        flush(stack[-1][1])
                    if name == "a":
                        in_link = max(0, in_link - 1)
                    cut(k)
                continue
            if name in RAW and name not in ("head", "option"):
                if name in CLOSED_RAW or not rest.rstrip().endswith("/"):
                    close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    if close is None:
                        unclosed.add(name)  # nor is there one further on
                    at = close.end() if close else (end if name in CLOSED_RAW else at)
                continue
            if name in BLOCK:
                flush(stack[-1][1])
                if name in CLOSES_P:
                    k = last(("p",))
                    if k > 0 and k > last(("button", "td", "th", "table")):
                        cut(k)
                        in_link = 0
                if name in LIST:
                    same, bounds = LIST[name]
                    k = last(same.split())
                    if k > 0 and k > last(bounds):
                        cut(k)
                if name in ("html", "hr"):
                    continue
                mask, gold = 0, None
                if rest.strip(" /"):
                    for key, x, y, z in ATTRIBUTE.findall(rest):
                        key = key.lower()
                        if key in ("class", "id", "role", "itemprop", "aria-label"):
                            for w in WORD.findall(x or y or z):
                                g = GROUP_OF.get(w.lower())
                                if g is not None:
                                    mask |= 1 << g
                        elif framed and key == "data-gold":
                            gold = (x or y or z) == "1"
                self.parent.append(stack[-1][1])
                self.tag.append(name)
                self.groups.append(mask)
                self.gold.append(gold)
                self.inner.append(0)
                push(name, len(self.tag) - 1)
            elif name not in VOID:
                if name == "a":
                    in_link += 1
                self.inner[stack[-1][1]] += 1
                push(name, stack[-1][1])
        flush(stack[-1][1])

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, links, marks, words, blocks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        before, seen = np.zeros(n), 0
        first = np.full(n, -1.0)
        for node, text, linked in self.runs:
            own[node] += len(text)
            links[node] += linked
            marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            words[node] += text.count(" ") + 1
            blocks[node] += 1
            if first[node] < 0:
                first[node] = seen
            seen += len(text)
        parent = np.array(self.parent)
        sub = {k: v.copy() for k, v in (("text", own), ("links", links), ("marks", marks), ("words", words), ("blocks", blocks))}
        nodes, paragraphs = np.ones(n) + np.array(self.inner), np.array([t == "p" for t in self.tag], dtype=float)
        total = [*sub.values(), nodes, paragraphs]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for v in total:
                v[p] += v[i]
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        before = np.maximum(first, 0) / max(seen, 1)
        depth, above = np.zeros(n), np.zeros((n, len(GROUPS)))
        above_tag = np.zeros((n, 4))  # article or main; navigation; form; table cell
        mask = np.array([[g >> k & 1 for k in range(len(GROUPS))] for g in self.groups], dtype=float)
        tag = np.zeros((n, N_TAGS))
        count: dict[int, int] = {}
        alike: dict[tuple[int, str], int] = {}
        place = np.zeros(n)
        for i, t in enumerate(self.tag):
            k = TAGS.get(t)
            if k is not None:
                tag[i, k] = 1
            if i:
                p = parent[i]
                depth[i] = depth[p] + 1
                above[i] = np.maximum(above[p], mask[p])
                above_tag[i] = above_tag[p]
                u = self.tag[p]
                if u in ("article", "main"):
                    above_tag[i, 0] = 1
                elif u in ("nav", "menu", "footer", "aside", "header"):
                    above_tag[i, 1] = 1
                elif u in ("form", "fieldset"):
                    above_tag[i, 2] = 1
                elif u in ("td", "th"):
                    above_tag[i, 3] = 1
                place[i] = count.get(p, 0)
                count[p] = count.get(p, 0) + 1
                alike[p, t] = alike.get((p, t), 0) + 1
        siblings = np.array([count.get(p, 1) for p in self.parent], dtype=float)
        same = np.array([alike.get((p, t), 1) for p, t in zip(self.parent, self.tag, strict=True)]) / siblings
        text = np.maximum(sub["text"], 1)
        up = np.maximum(parent, 0)
        wide = np.column_stack([np.log1p(sub["text"]), sub["links"] / text, sub["marks"] / np.maximum(sub["words"], 1), np.log1p(paragraphs)])
        return np.column_stack([
            wide[up], np.log1p(own), np.log1p(sub["text"]), sub["links"] / text, sub["marks"] / np.maximum(sub["words"], 1), np.log1p(sub["words"]),
            sub["text"] / np.maximum(sub["blocks"], 1) / 100, nodes / text * 10, np.log1p(paragraphs), sub["text"] / max(seen, 1), before,
            depth, np.log1p(siblings), place / np.maximum(siblings, 1), same, tag, mask, above, above_tag])

    def scores(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds times the logarithm of the text: of a node's own, or of a
        container's whole subtree. Also each node's own characters."""
        own = np.zeros(len(self.tag))
        for node, text, _ in self.runs:
            own[node] += len(text)
        whole = own.copy()
        for i in range(len(own) - 1, 0, -1):
            whole[self.parent[i]] += whole[i]
        return np.clip(odds, -6, 6) * np.log1p(np.where(own > 0, own, whole)), own

    def decode(self, odds: np.ndarray, leave: float = 24.0) -> str:
        """The text of the kept runs, one line each. A node is main text, or a
        mixed container, or other text. Under a container anything may be; under
        main text is main text, or other text at a price; under other text is
        other text alone. The states with the highest sum are taken; of equal sums,
        node by node in page order, other text goes before a container and a
        container before main text."""
        n = len(self.tag)
        score, own = self.scores(odds)
        main, other = score.copy(), -score
        mixed = np.where(own > 0, -1.0, -0.5) * np.abs(score)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            main[p] += max(main[i], other[i] - leave)
            mixed[p] += max(main[i], mixed[i], other[i])
            other[p] += other[i]
        state = ["mixed"] * n  # the page itself is a container
        for i in range(1, n):
            above = state[self.parent[i]]
            if above == "mixed":
                least = max(main[i], mixed[i], other[i]) - TIE
                state[i] = "other" if other[i] >= least else "mixed" if mixed[i] >= least else "main"
            elif above == "main":
                state[i] = "main" if main[i] > other[i] - leave + TIE else "other"
            else:
                state[i] = "other"
        return "\n".join(text for node, text, _ in self.runs if state[node] == "main")

    def labels(self) -> np.ndarray | None:
        """1 where at least half of a node's text is main text, -1 without text;
        None where nothing marks the main text."""
        n, inside, marked = len(self.tag), [False] * len(self.tag), False
        known = any(g is not None for g in self.gold)
        for i in range(1, n):
            up, tag = inside[self.parent[i]], self.tag[i]
            if self.gold[i] is not None:
                up, marked = self.gold[i], True
            elif not known:
                if tag in ("article", "main") and not (self.groups[i] >> 7 & 1):
                    up, marked = True, True
                elif tag in NEGATIVE_TAGS or self.groups[i] >> 1:
                    up = False
            inside[i] = up
        if not marked:
            return None
        good, total = np.zeros(n), np.zeros(n)
        for node, text, _ in self.runs:
            total[node] += len(text)
            good[node] += len(text) * inside[node]
        for i in range(n - 1, 0, -1):
            good[self.parent[i]] += good[i]
            total[self.parent[i]] += total[i]
        return np.where(total > 0, (2 * good >= total).astype(float), -1.0)


def layouts(page: Page, seed: int, n: int) -> list[str]:
    """The main text of a labelled page in other frames, labels in data-gold."""
    labels = page.labels()
    main = [(page.tag[k], entities.escape(t)) for k, t, _ in page.runs if labels[k] > 0]
    if not main:
        return []
    rng = random.Random(seed)
    pool = [s for _, t in main for s in re.split(r"(?<=[.!?]) ", t) if s] or ["Text."]

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(pool).split()[: rng.randint(a, b)])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(k))

    def prose(k: int) -> str:
        return "".join(f"<p>{' '.join(rng.choice(pool) for _ in range(rng.randint(1, 6)))}</p>" for _ in range(k))

    def said(options: str) -> str:
        name = rng.choice(options.split())
        return f'{rng.choice(("class", "id", "class"))}="{rng.choice(("", "site-", "page-", "block "))}{name}"'

    def other() -> list[str]:
        return [
            f'<nav data-gold="0"><ul>{links(rng.randint(2, 8))}</ul></nav>',
            f'<div {said("menu navbar breadcrumbs pagination")} data-gold="0"><ul>{links(rng.randint(2, 8))}</ul></div>',
            f'<header data-gold="0"><h1>{words(1, 5)}</h1><p>{words(3, 9)}</p></header>',
            f'<div {said("header masthead topbar")} data-gold="0"><h2>{words(1, 4)}</h2><p>{words(2, 8)}</p></div>',
            f'<aside data-gold="0"><h3>{words(1, 4)}</h3>{prose(rng.randint(0, 3))}<ul>{links(rng.randint(1, 6))}</ul></aside>',
            f'<div {said("sidebar widget side secondary")} data-gold="0"><h3>{words(1, 4)}</h3>{prose(rng.randint(1, 3))}</div>',
            f'<div {said("ad ads advert banner sponsored promo")} data-gold="0">{prose(1) if rng.random() < .5 else words(3, 12)}</div>',
            f'<div {said("cookie-notice consent notice popup alert disclaimer")} data-gold="0">{prose(1)}<button>{words(1, 2)}</button></div>',
            f'<form data-gold="0"><label>{words(1, 3)}</label><input><p>{words(3, 12)}</p><button>{words(1, 2)}</button></form>',
            f'<div {said("newsletter subscribe login search")} data-gold="0"><p>{words(4, 15)}</p><input></div>',
            f'<div {said("related share recommended more popular")} data-gold="0"><h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul></div>',
            f'<section {said("comments comment-list discussion")} data-gold="0"><h3>{words(1, 3)}</h3>'
            + "".join(f'<div {said("comment reply")}>{prose(rng.randint(1, 2))}</div>' for _ in range(rng.randint(1, 5))) + "</section>",
            f'<ol {said("comments replies")} data-gold="0">' + "".join(f"<li>{prose(1)}</li>" for _ in range(rng.randint(1, 4))) + "</ol>",
            f'<footer data-gold="0"><p>{words(3, 15)}</p></footer>',
            f'<div {said("footer copyright legal")} data-gold="0">{words(3, 15)}</div>',
        ]

    whole, out = main, []
    for k in range(n):
        # every other frame has short blocks, so that length alone tells little
        main = [(t, x if rng.random() < 0.3 else " ".join(x.split()[: rng.randint(1, 25)])) for t, x in whole] if k % 2 == 0 else whole
        if rng.random() < 0.5:
            main = main[: rng.randint(1, 8)]
        body = []
        for t, x in main:
            t = t if t in ("p", "li", "blockquote", "pre") or t[0] == "h" and t[1:].isdigit() else "p"
            if rng.random() < 0.3:
                t = rng.choice(("h2", "h3", "blockquote", "pre", "div", "li", "dd", "td", "figcaption"))
            body.append(f"<{t}>{x}</{t}>")
        for x in rng.sample(other(), rng.randint(0, 3)):
            body.insert(rng.randint(0, len(body)), x)
        attr = rng.choice(("", said("content entry-content post story article-text main")))
        tag = rng.choice(("article", "main", "div", "div", "section"))
        around = other()
        rng.shuffle(around)
        cut = rng.randint(0, 6)
        core = f'<{tag} {attr} data-gold="1">{"".join(body)}</{tag}>'
        if rng.random() < 0.5:
            core = f'<div class="{rng.choice(("wrapper", "container", "row", "page", "layout"))}">{around[7]}{core}{around[8]}</div>'
        out.append(f"<html><body>{''.join(around[:cut])}{core}{''.join(around[cut:7])}</body></html>")
    return out


@dataclass
class Trees:
    """Boosted trees as arrays: feature (-1 at a leaf), threshold, children, value."""
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= value[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return 2.0 * out


def _flat(node, weight: float):
    feature, value, left, right = [], [], [], []

    def walk(x) -> int:
        k = len(feature)
        for a in (feature, left, right):
            a.append(-1)
        value.append(0.0)
        if x.getClass().getSimpleName() == "LeafNode":
            value[k] = weight * x.prediction()
        else:
            feature[k], value[k] = x.split().featureIndex(), x.split().threshold()
            left[k], right[k] = walk(x.leftChild()), walk(x.rightChild())
        return k

    walk(node)
    return np.array(feature), np.array(value), np.array(left), np.array(right)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([Page(s).labels() is not None for s in batch.column(1).to_pylist()], pa.bool_()))


def fit(pages: DataFrame, opt: Extract = Extract()) -> Trees | None:
    """Boosted trees from a sample of the labelled pages; None without labelled
    text. Only pages that name a marked element can have labels; of those, more
    are drawn until enough do."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.filter(F.col("html").rlike(MARKED)).select(F.xxhash64("page_id", F.length("html")).alias("seed"), "html")
    share = min(1.0, opt.train_pages / max(1, rows.count()))
    while True:
        sample = scratch.keep(rows.filter(F.pmod("seed", F.lit(1 << 30)) < int(share * (1 << 30))).mapInArrow(_labelled, rows.schema))
        if share >= 1.0 or 2 * sample.count() >= opt.train_pages:
            break
        scratch.drop(sample)
        share = min(1.0, 4 * share)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for seed, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                if page.labels() is None:
                    continue
                for p in (page, *(Page(x, framed=True) for x in layouts(page, seed, opt.layouts))):
                    y = p.labels()
                    if y is not None:
                        use = (y >= 0) & (np.arange(len(y)) > 0)
                        xs.append(p.features()[use])
                        ys.append(y[use])
            if xs:
                x = np.concatenate(xs)
                yield batch_of(features=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())),
                               label=pa.array(np.concatenate(ys)))

    made = scratch.keep(sample.mapInArrow(label, "features array<double>, label double"))
    if made.select("label").distinct().count() < 2:
        return None
    share = made.agg(F.avg("label")).first()[0]
    weight = F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share))  # both classes count alike
    made = made.coalesce(2).select(array_to_vector("features").alias("features"), "label", weight.alias("weight")).cache()
    model = GBTClassifier(maxIter=opt.trees, maxDepth=opt.depth, stepSize=0.3, seed=7, weightCol="weight").fit(made)
    made.unpersist()
    return Trees([_flat(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights, strict=True)])


def _plain(page: Page) -> str:
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = inside[page.parent[i]] or page.tag[i] in NEGATIVE_TAGS
    return "\n".join(t for k, t, _ in page.runs if not inside[k])


def extract(pages: DataFrame, model: Trees | None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2).to_pylist()
            texts: list[str] = []
            for a in range(0, len(sources), 200):
                parsed = [Page(s or "") for s in sources[a:a + 200]]
                if model is None:
                    texts += map(_plain, parsed)
                    continue
                x = [p.features() for p in parsed]
                odds = model.odds(np.concatenate(x))
                ends = np.cumsum([len(k) for k in x])
                texts += [p.decode(odds[e - len(k):e]) for p, k, e in zip(parsed, x, ends, strict=True)]
            yield batch_of(page_id=batch.column(0), url=batch.column(1), text=pa.array(texts, pa.string()),
                           n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(main_text, "page_id long, url string, text string, n_chars long")
