"""Main text of web pages, by boosted trees over the nodes of the page.

A page becomes a tree of nodes (``html_tree``), each with features: its tag, words of its
class, id and role and of those above it, size, density of text, links and punctuation in its
subtree, depth, place, and how it compares with its siblings and parent. Boosted trees give
every node the chance that it is main text. Decoding is hierarchical: a node is main as a
whole, or dropped as a whole, or mixed, and then its children decide, at a price; the cheapest
labelling of the tree is taken, so nothing is dropped under a node that is kept as a whole and
nothing kept under one that is dropped.

The trees are fitted on the driver, on ``layouts`` made pages with known main text and on at
most ``bound`` pages of the table whose article or main element, less what the page itself
calls a menu, advert, form or comment, serves as label. Extraction is narrow: pages are worked
on where they are read. Scripts, styles and the like never are text.

Null pages give the empty text; a page without any element is main text as a whole. Repeated
rows and ids are rows of their own; other columns stay, and one with the name of an output is
replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .boosted_trees import BoostedTrees
from .common import with_batch_columns
from .html_tree import _GROUP_OF, Forest, Page, main_text
from .page_samples import sample_pages

LAYOUTS = 300
BOUND = 100
#: Characters of the longest page that the trees are fitted on.
LONGEST = 200_000
#: Price of a mixed node, and the say of a node without text of its own.
MIXED, EMPTY_WEIGHT = 1.5, 0.2
#: Characters of source that are worked on at once; a longer page is taken alone.
GROUP_CHARS = 2_000_000
_NOT_MAIN = _GROUP_OF["ad"] | _GROUP_OF["comments"] | _GROUP_OF["sidebar"] | _GROUP_OF["cookie"] | _GROUP_OF["menu"] | _GROUP_OF["share"]


def _named_by_page(page: Page) -> bool:
    """Give the nodes labels from the page's own elements; False if it has no single article or main."""
    roots = [n for n, t in enumerate(page.tag) if t in ("article", "main")]
    outer = [n for n in roots if page.parent[n] not in roots]
    if len(outer) != 1:
        return False
    page.label = [0] * len(page.tag)
    for n in range(1, len(page.tag)):
        other = page.tag[n] in ("nav", "aside", "form", "footer") or page.groups[n] & _NOT_MAIN
        page.label[n] = 1 if n == outer[0] else 0 if other else page.label[page.parent[n]]
    return True


def fit_trees(sources: list[str], layouts: int = LAYOUTS, seed: int = 10) -> BoostedTrees:
    """Trees fitted on made pages and on those of ``sources`` that name their main text."""
    pages = [Page(s) for s in sample_pages(layouts, seed)]
    pages += [p for p in (Page(s, marked=False) for s in sources) if _named_by_page(p)]
    forest = Forest(pages)
    label = np.concatenate([p.label for p in pages])
    # Nodes above both kinds take the label of most of their text.
    share = forest.subtree(np.column_stack([forest.own_chars * (label == 1), forest.own_chars]))
    y = np.where(label >= 0, label, share[:, 0] > 0.5 * np.maximum(share[:, 1], 1))
    used = ~forest.silent & (share[:, 1] > 0)
    weight = np.where(forest.own_chars > 0, 1.0, 0.3) / np.sqrt(np.repeat(np.bincount(np.repeat(np.arange(len(pages)), forest.sizes), used), forest.sizes).clip(1))
    return BoostedTrees().fit(forest.features()[used], y[used].astype(float), (weight / weight[used].mean())[used])


def decode(forest: Forest, logits: np.ndarray) -> np.ndarray:
    """Which nodes' own text is main text, by the cheapest labelling without contradictions."""
    weight = np.where(forest.own_chars > 0, 1.0, np.where(forest.sums[:, 0] > 0, EMPTY_WEIGHT, 0.0))
    weight[forest.starts] = 0
    z = np.clip(logits, -8, 8)
    keep, drop = weight * np.logaddexp(0, -z), weight * np.logaddexp(0, z)
    whole_keep, whole_drop = forest.subtree(np.column_stack([keep, drop])).T
    own = np.where(forest.own_chars > 0, np.minimum(keep, drop), 0)
    mixed = MIXED + own
    best = np.minimum(whole_keep, whole_drop)
    for level in reversed(forest.levels):
        best[level] = np.minimum(np.minimum(whole_keep[level], whole_drop[level]), mixed[level])
        below = level[forest.parent[level] >= 0]
        np.add.at(mixed, forest.parent[below], best[below])
    kept = np.zeros(len(z), np.int8)  # 1 kept, -1 dropped, 0 mixed
    choice = np.where(mixed < np.minimum(whole_keep, whole_drop), 0, np.where(whole_keep <= whole_drop, 1, -1))
    for level in forest.levels:
        parent = np.maximum(forest.parent[level], 0)
        above = np.where(forest.parent[level] >= 0, kept[parent], 0)
        kept[level] = np.where(above != 0, above, choice[level])
    return ((kept == 1) | ((kept == 0) & (z > 0))) & ~forest.silent


def extract(trees: BoostedTrees, sources: list[str]) -> list[str]:
    """Main text of every page."""
    out: list[str] = []
    at = 0
    while at < len(sources):
        to, size = at, 0
        while to < len(sources) and (to == at or size + len(sources[to]) <= GROUP_CHARS):
            size += len(sources[to])
            to += 1
        pages = [Page(s, marked=False) for s in sources[at:to]]
        forest = Forest(pages)
        kept = decode(forest, trees.logits(forest.features()))
        for page, start, n in zip(pages, forest.starts, forest.sizes):
            out.append(main_text(page, kept[start : start + n] if n > 1 else np.ones(1, bool)))
        at = to
    return out


@lru_cache(maxsize=4)
def _fitted(sources: tuple[str, ...], layouts: int) -> BoostedTrees:
    return fit_trees(list(sources), layouts)


def extract_pages(pages: DataFrame, html: str = "html", name: str = "text", layouts: int = LAYOUTS, bound: int = BOUND) -> DataFrame:
    """pages with the main text of each."""
    hashed = pages.select(F.xxhash64(html).alias("key"), html).where(F.col(html).isNotNull() & (F.length(html) < LONGEST))
    keys = [r[0] for r in hashed.select("key").distinct().orderBy("key").limit(bound).collect()]
    chosen = hashed.where(F.col("key").isin(keys)).groupBy("key").agg(F.min(html).alias("page")).orderBy("key")
    trees = _fitted(tuple(r["page"] for r in chosen.collect()), layouts)  # at most ``bound`` pages

    def compute(sources):
        return {name: pa.array(extract(trees, [s or "" for s in sources]), pa.string())}

    return with_batch_columns(pages, [html], {name: StringType()}, compute)
