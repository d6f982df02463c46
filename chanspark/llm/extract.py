"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page is read into layout nodes (dom.py). For each node the trees give probabilities of three classes: its subtree is
all article, all something else, or mixed. Features are subtree text and link density, tags and words of the attributes
of the node and of what it stands in, depth, position, and how it compares to its siblings. The labels are then chosen
together: from the leaves up, the best labelling of each subtree as all article, all else, or mixed with its children's
best labellings; from the root down, the best one is read off. A node of the article so has no part outside it, and no
node outside the article has a part within it. Text directly in a node with parts is a part of its own.

The model is trained on TRAIN_PAGES made-up pages and a third as many bare ones (pagemaker.py) from fixed seeds, once for each driver process; no rows
of the corpus are used. Pages are mapped over Arrow batches, without a shuffle.

Nulls: a null or empty page has the empty text. Repeated rows are read one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, dom
from .common import map_batches
from .pagemaker import NAMES, make_bare, make_page

TRAIN_PAGES = 360
#: Beside so many made-up pages there is one of little layout.
BARE_SHARE = 3
ROUNDS = 16
#: Text that is read together, in characters.
BLOCK_CHARS = 1_000_000
ELSE, MIXED, ARTICLE = range(3)

_TAG_CLASSES = {
    t: n
    for n, tags in enumerate(("article main", "header hgroup", "footer", "nav menu", "aside", "form fieldset", "button select option optgroup datalist label input", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dir", "li", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption dl dt dd details summary", "body html #page", "dialog address", "#text"))
    for t in tags.split()
}
N_TAGS = max(_TAG_CLASSES.values()) + 2
_PARTS = list(NAMES)
_PART_WORDS = {w: n for n, part in enumerate(_PARTS) for w in NAMES[part]} | {w: _PARTS.index(part) for part, words in {"article": "articlebody post-content hentry", "menu": "navigation menubar", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "form"}.items() for w in words.split()}
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_STOPS = re.compile(r"[.,;:!?]")


@cache
def part_of(words: str) -> int:
    """Bits of the parts that an element's attribute words speak of; the bit after them: hidden."""
    bits = 0
    for token in _WORD.findall(words.lower()):
        pieces = [token, *(token.split("-") if token not in _PART_WORDS else [])]
        for p in pieces:
            n = _PART_WORDS.get(p, _PART_WORDS.get(p.removesuffix("s")))
            if n is not None:
                bits |= 1 << n
        if token == "hidden":
            bits |= 1 << len(_PARTS)
    return bits


class Tree:
    """Arrays over the nodes of one page, with a node "#text" for text directly in a node that has parts."""

    def __init__(self, page: dom.Page):
        tags, parents, words = page.tags, page.parents, page.words
        n = len(tags)
        shown = dom.visible(page)
        has_parts = bytearray(n)
        for p in parents[1:]:
            has_parts[p] = 1
        # Where the pieces belong: to their node, or to its "#text".
        own: dict[int, int] = {}
        self.tags, self.parents, self.words = list(tags), list(parents), list(words)
        self.places: list[int] = []
        for node, text, _ in page.pieces:
            if text is not None and has_parts[node] and not text.isspace():
                if node not in own:
                    own[node] = len(self.tags)
                    self.tags.append("#text"), self.parents.append(node), self.words.append("")
                self.places.append(own[node])
            else:
                self.places.append(node)
        self.shown = shown + [shown[p] for p in self.parents[n:]]
        self.n_inner = page.n_inner + [0] * (len(self.tags) - n)

    def features(self, page: dom.Page) -> np.ndarray:
        n = len(self.tags)
        chars, linked, word_count, stops, ends = ([0] * n for _ in range(5))
        before, seen = [-1] * n, 0
        last = [""] * n
        for place, (_, text, in_link) in zip(self.places, page.pieces, strict=True):
            if text is None or not self.shown[place] or not (size := len(text)):
                continue
            if before[place] < 0:
                before[place] = seen
            chars[place] += size
            seen += size
            linked[place] += size * in_link
            word_count[place] += text.count(" ") + 1
            stops[place] += len(_STOPS.findall(text))
            if not text.isspace():
                last[place] = text
        for k in range(n):
            ends[k] = last[k].rstrip()[-1:] in (".", "!", "?", "…", "。")
        up = np.array(self.parents)
        tag = np.array([_TAG_CLASSES.get(t, N_TAGS - 1) for t in self.tags])
        bits = np.array([part_of(w) for w in self.words])
        # Sums over subtrees, and what a node stands in. Parents come before their children, but for "#text".
        order = range(n - 1, 0, -1)
        total = np.array([chars, linked, word_count, stops, ends, [1 + i for i in self.n_inner], [t == "p" for t in self.tags], [t in ("li", "td", "option") for t in self.tags], [t in ("h1", "h2", "h3", "h4") for t in self.tags], [t in ("form", "button", "label", "select") for t in self.tags], [bool(b & ~1) for b in bits.tolist()]], dtype=np.int64).T.tolist()
        parents = self.parents
        first = before
        for k in order:
            p = parents[k]
            total[p] = [a + b for a, b in zip(total[p], total[k], strict=True)]
            if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
                first[p] = first[k]
        depth, in_tags, in_bits, index, count, before_same = ([0] * n for _ in range(6))
        sizes = [t[0] for t in total]
        kids: list[list[int]] = [[] for _ in range(n)]
        tag_list, bit_list = tag.tolist(), bits.tolist()
        for k in range(1, n):
            p = parents[k]
            depth[k] = depth[p] + 1
            in_tags[k] = in_tags[p] | 1 << tag_list[p]
            in_bits[k] = in_bits[p] | bit_list[p]
            kids[p].append(k)
        largest = [max((sizes[c] for c in k), default=0) for k in kids]
        for k, own in enumerate(kids):
            del k
            for i, c in enumerate(own):
                index[c], count[c] = i, len(own)
                before_same[c] = i > 0 and tag_list[own[i - 1]] == tag_list[c]
        t = np.array(total, dtype=np.float64)
        size, one = t[:, 0], np.maximum(t[:, 0], 1)
        parent_size = np.array([largest[p] if p >= 0 else 0 for p in parents], dtype=np.float64)
        in_tags_, in_bits_ = np.array(in_tags), np.array(in_bits)
        columns = [
            np.minimum(depth, 12), np.log1p(size), t[:, 1] / one, t[:, 2] / one, t[:, 3] / np.maximum(t[:, 2], 1), t[:, 4] / np.maximum(t[:, 6], 1), np.log1p(size / t[:, 5]), size / max(seen, 1),
            np.array(first) / max(seen, 1), (np.array(first) + size) / max(seen, 1), np.log1p(t[:, 6]), t[:, 7] / t[:, 5], np.log1p(t[:, 8]), np.log1p(t[:, 9]), np.log1p(t[:, 10]), np.log1p(t[:, 2]),
            np.array(index) / np.maximum(count, 1), np.minimum(count, 20), size / np.maximum(parent_size, 1), size / np.maximum(size[np.maximum(up, 0)], 1), np.array(before_same), np.array(ends), tag, tag[np.maximum(up, 0)], np.array([len(k) for k in kids]),
        ]
        columns += [(tag == k).astype(float) for k in range(N_TAGS)]
        columns += [(in_tags_ >> k) & 1 for k in range(7)]
        columns += [(bits >> k) & 1 for k in range(len(_PARTS) + 1)]
        columns += [(in_bits_ >> k) & 1 for k in range(len(_PARTS) + 1)]
        return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)

    def decode(self, logs: np.ndarray, filled: list[bool]) -> list[bool]:
        """Whether each node is of the article, from log-probabilities (rows: nodes). Nodes without text cost nothing."""
        n = len(self.tags)
        # Best sums for a subtree that is all of one kind, and for one that may be mixed.
        none, mixed, whole = ([0.0] * n for _ in range(3))
        parts = bytearray(n)
        values = logs.tolist()
        for k in range(n):
            if filled[k]:
                none[k], mixed[k], whole[k] = values[k]
        free = [0.0] * n  # over the parts: the best of each on its own
        best = [0] * n
        for k in range(n - 1, -1, -1):
            if not filled[k]:
                continue
            choices = [(none[k], ELSE), (whole[k], ARTICLE)]
            if parts[k]:
                choices.append((mixed[k] + free[k], MIXED))
            value, best[k] = max(choices)
            if (p := self.parents[k]) >= 0:
                none[p] += none[k]
                whole[p] += whole[k]
                free[p] += value
                parts[p] = 1
        state = [ELSE] * n
        for k in range(n):
            p = self.parents[k]
            above = state[p] if p >= 0 else MIXED
            state[k] = above if above != MIXED else best[k] if filled[k] else ELSE
            if not self.shown[k]:
                state[k] = ELSE
        return [s == ARTICLE for s in state]


def _filled(tree: Tree, page: dom.Page) -> list[bool]:
    """Whether there is text in a node or below it."""
    out = [False] * len(tree.tags)
    for place, (_, text, _) in zip(tree.places, page.pieces, strict=True):
        if text is not None and tree.shown[place] and not out[place] and not text.isspace():
            out[place] = True
    for k in range(len(out) - 1, 0, -1):
        if out[k]:
            out[tree.parents[k]] = True
    return out


def _labels(tree: Tree, page: dom.Page) -> tuple[np.ndarray, np.ndarray]:
    """Class of each node of a made-up page, and whether it has text at all."""
    n = len(tree.tags)
    inside, outside = [0] * n, [0] * n
    for place, (_, text, _) in zip(tree.places, page.pieces, strict=True):
        if text and tree.shown[place]:
            own = sum("a" <= c <= "z" for c in text)
            inside[place] += own
            outside[place] += sum("Ͱ" <= c <= "Ͽ" for c in text)
    for k in range(n - 1, 0, -1):
        inside[tree.parents[k]] += inside[k]
        outside[tree.parents[k]] += outside[k]
    i, o = np.array(inside), np.array(outside)
    return np.where(i == 0, ELSE, np.where(o == 0, ARTICLE, MIXED)), (i + o) > 0


@cache
def model(pages: int = TRAIN_PAGES, rounds: int = ROUNDS) -> boosting.Trees:
    xs, ys = [], []
    for html, _ in [*map(make_page, range(pages)), *map(make_bare, range(pages // BARE_SHARE))]:
        page = dom.read(html)
        tree = Tree(page)
        y, known = _labels(tree, page)
        xs.append(tree.features(page)[known])
        ys.append(y[known])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys), 3, rounds)


def main_texts(sources: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main text of each page."""
    out, at = [], 0
    while at < len(sources):
        read, size = [], 0
        while at < len(sources) and (not read or size < BLOCK_CHARS):
            size += len(sources[at] or "")
            page = dom.read(sources[at])
            read.append((page, Tree(page)))
            at += 1
        features = [tree.features(page) for page, tree in read]
        logs = trees.scores(np.concatenate(features))
        first = 0
        for (page, tree), x in zip(read, features, strict=True):
            chosen = tree.decode(logs[first : first + len(x)], _filled(tree, page))
            first += len(x)
            parts = [" " if t is None else t for place, (_, t, _) in zip(tree.places, page.pieces, strict=True) if t is None or chosen[place]]
            out.append(" ".join("".join(parts).split()))
    return out


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", trees: boosting.Trees | None = None) -> DataFrame:
    """Per row of pages: id, url, main text and its length in code points."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(batch.column(2).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return map_batches(rows, run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", key)
