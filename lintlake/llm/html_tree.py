"""Web pages as flat arrays of nodes, with what a classifier of nodes wants to know."""

from __future__ import annotations

import html as _html
import re

import numpy as np

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style noscript template iframe svg math textarea select option title head object embed canvas noembed noframes datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that close an open element of these kinds, up to a boundary.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
P_STAYS = INLINE | VOID - {"hr"} | {"script", "style", "template", "noscript", "iframe", "svg", "button", "select", "option", "object"}

#: Kinds of tags as the classifier sees them.
TAG_KINDS = {
    name: k
    for k, names in enumerate(
        ("p", "div", "span", "a", "li", "ul ol dl menu", "h1", "h2 h3 h4 h5 h6", "article main", "section", "nav", "header", "footer",
         "aside", "form fieldset input button select label textarea", "table tbody thead tr", "td th", "figure figcaption",
         "blockquote pre code", "b i em strong u small sub sup mark q cite abbr time", "body html"), 1,
    )
    for name in names.split()
}
KINDS = 22
#: Words in class, id and role attributes, by what they speak for.
TOKENS = {
    "main": "article articlebody body content entry main post story text page blog single prose richtext",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager sitemap header masthead logo banner hdr",
    "foot": "footer foot copyright legal bottom colophon contentinfo ftr",
    "side": "aside side sidebar rail widget complementary related recommended recommendations popular trending more tags categories archive teaser",
    "advert": "ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored partner outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog paywall newsletter subscribe signup toast hidden",
    "form": "form search login register input button contact",
    "talk": "comment comments reply replies respond discussion disqus thread reader readers feedback review reviews",
    "share": "share sharing social follow like facebook twitter buttons",
    "meta": "meta byline author date time published dateline info",
}
GROUPS = list(TOKENS)
_GROUP_OF: dict[str, int] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _GROUP_OF[_w] = _GROUP_OF.get(_w, 0) | 1 << _k

_MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: An attribute: its name and, after an equals sign, its value.
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|\S*))?""")
_NAMED = frozenset(("class", "id", "role"))
_HIDDEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true|\shidden(?=[\s>=/]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BREAK = -1


class Page:
    """Nodes of one page in page order (a parent before its children), and its text pieces.

    ``pieces`` holds (node, raw text) in page order, and (BREAK, "") between blocks. Node 0 is
    the page itself. ``marked`` pages (made ones) name their main text by the attribute ``_y``;
    in any other page it is an attribute like others.
    """

    def __init__(self, source: str, marked: bool = True):
        self._marked = marked
        self.tag, self.parent, self.depth, self.groups, self.silent, self.label = ["#"], [-1], [0], [0], [False], [-1]
        self.pieces: list[tuple[int, str]] = []
        self._open, self._counts = [0], {}
        self._parse(source)

    def _push(self, name: str, attributes: str, keep: bool) -> None:
        above = self._open[-1]
        groups, label = 0, self.label[above]
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if key == "_y":
                    if self._marked and value in ("0", "1"):
                        label = int(value)
                elif key.lower() in _NAMED:
                    for w in _WORDS.findall(value):
                        groups |= _GROUP_OF.get(w.lower(), 0)
            if _HIDDEN.search(attributes):
                groups |= _GROUP_OF["hidden"]
        self.tag.append(name)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.groups.append(groups)
        self.silent.append(self.silent[above] or name in SILENT)
        self.label.append(label)
        if keep:
            self._open.append(len(self.tag) - 1)
            self._counts[name] = self._counts.get(name, 0) + 1

    def _pop(self) -> str:
        name = self.tag[self._open.pop()]
        self._counts[name] -= 1
        return name

    def _close_within(self, names: tuple, bounds: tuple) -> None:
        if not any(self._counts.get(n) for n in names):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag in names:
                while len(self._open) > k:
                    self._pop()
                return
            if tag in bounds:
                return

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        lost: set[str] = set()  # what does not occur any more

        def find(what: str, start: int) -> int:
            if what in lost:
                return -1
            found = source.find(what, start)
            if found < 0:
                lost.add(what)
            return found

        while at < size:
            m = _MARK.search(source, at)
            if not m:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            if m[2] is None:
                end = find("-->", m.end()) if m[0] == "<!--" else find(">", m.end())
                at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            end = m.end()
            while True:  # to the first > outside quotes
                stop = find(">", end)
                if stop < 0:
                    break
                quotes = [q for q in (source.find('"', end, stop), source.find("'", end, stop)) if q >= 0]
                opened = [q for q in quotes if source[q - 1] in "= \t\n"]
                if not opened:
                    break
                q = min(opened)
                closing = find(source[q], q + 1)
                if closing < 0:
                    break
                end = closing + 1
            if stop < 0:
                break  # the page ends inside a tag
            name = m[2].lower()
            attributes = source[m.end() : stop]
            at = stop + 1
            if m[1]:
                self._end(name)
            else:
                at = self._start(name, attributes, source, at)

    def _start(self, name: str, attributes: str, source: str, at: int) -> int:
        if self._counts.get("p") and name not in P_STAYS:
            self._close_within(("p",), ("td", "th", "button", "object"))
        if name in CLOSES:
            self._close_within(*CLOSES[name])
        if name not in INLINE:
            self._break()
        if name == "br":
            self._text(" ")
            return at
        self._push(name, attributes, name not in VOID and name not in RAW)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            if not end:
                return len(source)
            stop = source.find(">", end.end())
            return len(source) if stop < 0 else stop + 1
        return at

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._break()
        if self._counts.get(name):
            while self._pop() != name:
                pass

    def _break(self) -> None:
        if self.pieces and self.pieces[-1][0] != BREAK:
            self.pieces.append((BREAK, ""))

    def _text(self, raw: str) -> None:
        self.pieces.append((self._open[-1], raw))


def main_text(page: Page, kept: np.ndarray) -> str:
    """Text of the kept nodes: blocks in page order, white space in one blank, two line feeds between."""
    blocks, block = [], []
    for node, raw in [*page.pieces, (BREAK, "")]:
        if node != BREAK:
            if kept[node]:
                block.append(raw)
        elif block:
            text = " ".join(_html.unescape("".join(block)).split())
            if text:
                blocks.append(text)
            block = []
    return "\n\n".join(blocks)


_SUMS = ("chars", "words", "stops", "links", "tags", "p", "li", "a", "inputs", "p_chars", "texts")
FEATURES = (
    [f"tag{k}" for k in range(KINDS)]
    + [f"own_{g}" for g in GROUPS] + [f"above_{g}" for g in GROUPS]
    + ["in_menu_tag", "in_main_tag", "in_form_tag", "depth", "place", "size", "own_size", "links", "stops", "word_length", "per_text", "per_tag",
       "p_share", "n_p", "n_li", "n_a", "inputs", "share_of_parent", "share_of_page", "siblings", "same", "index", "parent_links",
       "parent_stops", "parent_kind", "beside_size", "before", "after", "beside_p"]
)


class Forest:
    """Nodes of several pages in one set of arrays, with features and sums over subtrees."""

    def __init__(self, pages: list[Page]):
        self.sizes = np.array([len(p.tag) for p in pages])
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, self.starts)]) if pages else np.zeros(0, int)
        self.parent[self.starts] = -1
        self.depth = np.concatenate([p.depth for p in pages]) if pages else np.zeros(0, int)
        self.kind = np.array([TAG_KINDS.get(t, 0) for p in pages for t in p.tag], int)
        self.groups = np.concatenate([p.groups for p in pages]) if pages else np.zeros(0, int)
        self.silent = np.concatenate([p.silent for p in pages]) if pages else np.zeros(0, bool)
        tags = np.array([t for p in pages for t in p.tag])
        own = np.zeros((n, len(_SUMS)))
        for page, start in zip(pages, self.starts):
            for node, raw in page.pieces:
                if node == BREAK or page.silent[node]:
                    continue
                text = raw.strip()
                if text:
                    own[start + node, [0, 1, 2, 10]] += len(text), text.count(" ") + 1, sum(map(text.count, ".,;!?")), 1
        self.own_chars = own[:, 0].copy()
        own[:, 4] = 1
        for k, name in ((5, "p"), (6, "li"), (7, "a")):
            own[:, k] = tags == name
        own[:, 8] = np.isin(tags, ["input", "button", "select", "textarea", "form"])
        self._levels()
        link = self._below(tags == "a")
        own[:, 3] = np.where(link, own[:, 0], 0)
        own[:, 9] = np.where(self._below(tags == "p"), own[:, 0], 0)
        self.sums = self.subtree(own)
        self.menu_tag = self._below(np.isin(tags, ["nav", "header", "footer", "aside"]))
        self.main_tag = self._below(np.isin(tags, ["article", "main"]))
        self.form_tag = self._below(np.isin(tags, ["form", "button", "select", "label"]))

    def _levels(self) -> None:
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange((self.depth.max() if len(order) else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def subtree(self, own: np.ndarray) -> np.ndarray:
        """Sums of each node and all below it."""
        out = own.astype(float).copy()
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def _below(self, flags: np.ndarray) -> np.ndarray:
        """Is the node or one above it flagged?"""
        out = flags.copy()
        for level in self.levels[1:]:
            out[level] |= out[self.parent[level]]
        return out

    def features(self) -> np.ndarray:
        s = dict(zip(_SUMS, self.sums.T))
        n, root = len(self.kind), np.repeat(self.starts, self.sizes)
        above = np.maximum(self.parent, root)
        chars = np.maximum(s["chars"], 1)
        own_groups = (self.groups[:, None] >> np.arange(len(GROUPS)) & 1).astype(bool)
        above_groups = own_groups.copy()
        for level in self.levels[1:]:
            above_groups[level] |= above_groups[self.parent[level]]
        index = np.arange(n) - root
        before = np.cumsum(self.own_chars) - self.own_chars
        before -= before[root]
        page = np.maximum(s["chars"][root], 1)
        siblings = np.bincount(above, minlength=n)[above]
        _, group, same = np.unique(above * KINDS + self.kind, return_inverse=True, return_counts=True)
        p_beside = np.bincount(above, weights=(self.kind == 1) * 1.0, minlength=n)[above]
        log = np.log1p
        columns = [self.kind == k for k in range(KINDS)]
        columns += [*own_groups.T, *above_groups.T, self.menu_tag, self.main_tag, self.form_tag]
        columns += [
            self.depth, before / page, log(s["chars"]), log(self.own_chars), s["links"] / chars, 100 * s["stops"] / chars,
            s["chars"] / np.maximum(s["words"], 1), log(s["chars"] / np.maximum(s["texts"], 1)), log(s["chars"] / s["tags"]),
            s["p_chars"] / chars, log(s["p"]), log(s["li"]), log(s["a"]), log(s["inputs"]), s["chars"] / np.maximum(s["chars"][above], 1),
            s["chars"] / page, log(siblings), log(same[group]), index / np.repeat(self.sizes, self.sizes), s["links"][above] / chars[above],
            100 * s["stops"][above] / chars[above], self.kind[above], log(s["chars"][above] - s["chars"]), log(before),
            log(np.maximum(page - before - s["chars"], 0)), log(p_beside),
        ]
        return np.column_stack([np.asarray(c, np.float32) for c in columns])
