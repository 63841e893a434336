"""Content of web pages by a tree-structured graphical model over the nodes of their documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.I | re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MARKS = re.compile(r"[.,;:!?。，、؟]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: What a start tag closes if it is open within the nearest of the second.
CLOSES = {
    **dict.fromkeys(BLOCK - {"body", "html", "li", "td", "th", "tr", "dd", "dt"}, ({"p"}, {"table", "td", "th", "button"})),
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}),
}
#: Elements that say themselves that they are the content: they label pages for training, and the model doesn't see them.
TELLING = frozenset({"article", "main"})
TEXT = "#text"


class Tree:
    """Nodes of a page in document order: ``parent``, ``depth``, ``tag``, ``name`` (first of its class, id or role), and of text
    nodes ``text``, whether it is in a link, and its marks.  ``content`` says of each node whether a telling element holds it."""

    def __init__(self, html: str) -> None:
        self.parent, self.depth, self.tag, self.name, self.text, self.link, self.content = [-1], [0], ["#page"], [""], [""], [False], [False]
        stack, at = [0], 0
        links = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._words(html[at : m.start()], stack[-1], links > 0)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag), 0)
                if k:
                    links -= sum(self.tag[i] == "a" for i in stack[k:])
                    del stack[k:]
                continue
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in ends:
                        links -= sum(self.tag[i] == "a" for i in stack[k:])
                        del stack[k:]
                        break
                    if t in scope:
                        break
            names = _NAMES.search(m["attrs"]) if m["attrs"] else None
            words = next((x for x in names.groups() if x), "").lower().split() if names else []
            i = self._add(stack[-1], tag, words[0] if words else "", "", False)
            if tag not in VOID and not m["attrs"].endswith("/"):
                stack.append(i)
                links += tag == "a"
        if at < len(html):
            self._words(html[at:], stack[-1], links > 0)

    def _add(self, parent: int, tag: str, name: str, text: str, link: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.name.append(name)
        self.text.append(text)
        self.link.append(link)
        self.content.append(self.content[parent] or tag in TELLING)
        return len(self.tag) - 1

    def _words(self, raw: str, parent: int, link: bool) -> None:
        text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if text:
            self._add(parent, TEXT, "", text, link)

    def show(self, keep: list[bool]) -> str:
        """The kept texts; a new line for each new block."""
        lines: list[str] = []
        last = -1
        for i, ok in enumerate(keep):
            if ok and self.text[i]:
                block = self.parent[i]
                while block > 0 and self.tag[block] not in BLOCK:
                    block = self.parent[block]
                if block == last:
                    lines[-1] += f" {self.text[i]}"
                else:
                    lines.append(self.text[i])
                last = block
        return "\n".join(lines)


def _shown(tag: str) -> str:
    return "div" if tag in TELLING else tag


class Forest:
    """The nodes of several trees as arrays, and their features: tag, name (or its parent's), and bins of the size of a node's text, its share in
    links, its marks, its tag above and its place in the page."""

    def __init__(self, trees: list[Tree]) -> None:
        self.size = np.array([len(t.tag) for t in trees])
        first = np.concatenate(([0], np.cumsum(self.size)))
        self.first = first
        self.depth = np.concatenate([np.array(t.depth) for t in trees])
        self.parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first.tolist())])
        self.parent[first[:-1]] = -1
        flat = [x for t in trees for x in t.text]
        chars = np.array([len(x) for x in flat], np.float64)
        linked = chars * np.concatenate([np.array(t.link) for t in trees])
        marks = np.array([len(_MARKS.findall(x)) if x else 0 for x in flat], np.float64)
        by_depth = np.argsort(self.depth, kind="stable")
        self.levels = np.split(by_depth, np.cumsum(np.bincount(self.depth))[:-1])
        for level in self.levels[:0:-1]:
            for x in (chars, linked, marks):
                np.add.at(x, self.parent[level], x[level])
        place = (np.arange(len(chars)) - np.repeat(first[:-1], self.size)) / np.repeat(self.size, self.size)
        tags = [_shown(x) for t in trees for x in t.tag]
        names = [x for t in trees for x in t.name]
        names = [x or (names[i] if i >= 0 else "") for x, i in zip(names, self.parent.tolist())]
        above = [tags[i] if i >= 0 else "" for i in self.parent.tolist()]
        size = np.minimum(np.log2(chars + 1), 12).astype(int)
        share = np.minimum(5 * linked / np.maximum(chars, 1), 4).astype(int) + (linked > 0)
        dense = np.minimum(100 * marks / np.maximum(chars, 1), 6).astype(int)
        self.tags = tags
        self.columns = [[f"{k}:{x}" for x in column] for k, column in enumerate((tags, names, size.tolist(), share.tolist(), dense.tolist(), above, (8 * place).astype(int).tolist()))]


class Model:
    """Log potentials: of each feature of a node under both labels, and of each pair of a node's and its parent's labels, by tag."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        """rows: key, label (for pairs, 2 * parent's + own), count."""
        total = np.ones(2)
        features: dict[str, np.ndarray] = {}
        pairs: dict[str, np.ndarray] = {}
        for key, label, n in rows:
            if key.startswith("pair:"):
                pairs.setdefault(key[5:], np.zeros((2, 2)))[label // 2, label % 2] += n
            else:
                features.setdefault(key, np.zeros(2))[label] += n
                if key.startswith("0:"):
                    total[label] += n
        self.features = {k: np.log((n + 0.5) / (total + 1)) for k, n in features.items()}
        self.unseen = np.zeros(2)
        # a tag's own transitions lean on those of all tags, as if each had been seen ten times
        shared = sum(pairs.values(), np.ones((2, 2)))
        shared = shared / shared.sum(axis=1, keepdims=True)
        of = lambda n: np.log((n + 10 * shared) / (n + 10 * shared).sum(axis=1, keepdims=True))
        self.pairs = {k: of(n) for k, n in pairs.items()}
        self.shared = of(np.zeros((2, 2)))
        self.trained = bool(features)

    def marginals(self, f: Forest) -> np.ndarray:
        """Probability that each node is content, by sum-product: messages from the leaves to the roots, then back."""
        if not self.trained:
            return np.zeros(len(f.depth))
        own = np.zeros((len(f.depth), 2))
        for column in f.columns:
            values = list(dict.fromkeys(column))
            code = {x: i for i, x in enumerate(values)}
            table = np.array([self.features.get(x, self.unseen) for x in values])
            own += table[[code[x] for x in column]]
        own /= 2  # features of a node depend on each other
        values = list(dict.fromkeys(f.tags))
        code = {x: i for i, x in enumerate(values)}
        pair = np.array([self.pairs.get(x, self.shared) for x in values])
        tag = np.array([code[x] for x in f.tags])
        message = np.zeros((len(own), 2))
        for level in f.levels[:0:-1]:
            x = pair[tag[level]] + own[level][:, None, :]
            message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(own, f.parent[level], message[level])
        belief = own.copy()
        belief[f.levels[0], 1] -= 20  # a page as a whole isn't content
        for level in f.levels[1:]:
            up = belief[f.parent[level]] - message[level]
            x = pair[tag[level]] + up[:, :, None]
            belief[level] += np.logaddexp(x[:, 0, :], x[:, 1, :])
            belief[level] -= belief[level].max(axis=1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def train(pages: DataFrame, rows: int = 2000, least: int = 3) -> Model:
    """A model from at most ``rows`` labelled pages, the first in order of a hash of page_id.

    A page is labelled if it has an ``article`` or ``main`` element with text: the nodes within are content, all others aren't.
    The model sees such elements as ``div``, so it works on pages without.  Keys of fewer than ``least`` nodes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            trees = [t for x in batch.column(0).to_pylist() if any((t := Tree(x)).content)]
            if not trees:
                continue
            f = Forest(trees)
            y = np.concatenate([np.array(t.content) for t in trees]).astype(int)
            label = y.tolist()
            for column in f.columns:
                counts.update(zip(column, label))
            up = (2 * y[np.maximum(f.parent, 0)] + y).tolist()
            counts.update((f"pair:{t}", k) for t, k, p in zip(f.tags, up, f.parent.tolist()) if p >= 0)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([v for _, v in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["key", "label", "n"])

    order = F.xxhash64("page_id")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    telling = F.col("html").rlike(f"(?i)<({'|'.join(sorted(TELLING))})\\b")
    chosen = keyed.filter(F.col("page_id").isNotNull() & telling).select("page_id").distinct().orderBy(order, "page_id").limit(rows)
    sample = keyed.filter(telling).join(F.broadcast(chosen), "page_id").select("html")
    counted = sample.mapInArrow(run, "key string, label int, n long").groupBy("key", "label").agg(F.sum("n").alias("n"))
    kept = counted.filter(F.col("n") >= least)
    return Model([tuple(r) for r in kept.collect()])  # bounded by the sample


def extract(pages: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``page_id, n_nodes, n_content, text`` of each row: its nodes, its text nodes that are content with a probability of at
    least the threshold, and their text, blocks on lines of their own.

    A null or empty page has no nodes and no text; so has every page if there was nothing to train on.  Pages of any
    length are read as a whole; an empty table gives no rows.  Ids may be null or repeated; other columns are ignored, whatever their names."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "html"):
            trees = [Tree(x) for x in texts.to_pylist()]
            f = Forest(trees)
            p = sent.value.marginals(f) >= threshold
            text = np.array([x == TEXT for x in f.tags])
            keep = p & text
            shown = [t.show(keep[a:b].tolist()) for t, a, b in zip(trees, f.first[:-1].tolist(), f.first[1:].tolist())]
            n = np.add.reduceat(keep.astype(np.int64), f.first[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.size - 1, pa.int64()), pa.array(n, pa.int64()), pa.array(shown, pa.string())], names=["page_id", "n_nodes", "n_content", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, n_nodes long, n_content long, text string")
