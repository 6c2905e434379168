"""Pages as trees of blocks, and the alignment of two trees by simple tree matching.

A page becomes a shape and blocks of text. The shape is the tree of its block elements, each with a label of its tag and
its classes; neighbours with the same label are one node, so that lists and paragraphs of any length have the same shape. A
block is the text between two borders of block elements, with the node that holds it. Parsing follows what browsers
do with unclosed paragraphs, list items and table cells, with raw text of scripts, and with comments.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

# Elements that flow within a line; all others border blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("base link meta noscript template basefont".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element of the first set ends when one of these begins, unless an element of the second set is met first.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Elements that are never part of an article's text, and roles and words in classes and ids that say the same.
_LEFT_OUT = frozenset(
    "head nav footer aside button select datalist dialog menu svg math canvas object audio video map template noscript optgroup option progress meter".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager masthead banner topbar footer sidebar aside widget widgets rail "
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promoted promotion cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe subscription signup login comment comments "
    "commentlist disqus replies reply respond discussion share sharing social related recommended recommendations toolbar search hidden "
    "skip copyright legal".split()
)
_OWN = frozenset("article post entry story".split())
# Deeper elements are not told apart from the node that holds them; their text is kept like any other.
DEPTH = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|style|aria-hidden|hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_TELLING = re.compile(r"class|id|role|itemprop|style|hidden", re.IGNORECASE)
_QUALIFIED = re.compile(r"\b(?:has|with|no|without|hide|show)[-_]\S+", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^A-Za-z]+")

#: Flags of labels: left out always; left out unless an article or main element is inside; a header; an article; a main element.
OUT, OUT_UNLESS, HEADER, ARTICLE, MAIN = 1, 2, 4, 8, 16


@lru_cache(maxsize=1 << 14)
def label_of(name: str, attrs: str) -> str:
    """A node's label: tag, flags and the words of class and id."""
    flags, words = 0, []
    if attrs and _TELLING.search(attrs):
        for match in _ATTRIBUTE.finditer(attrs):
            key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
            if key == "role":
                flags |= OUT if value.strip().lower() in _ROLES else MAIN if value.lower() == "main" else ARTICLE if value.lower() == "article" else 0
            elif key == "itemprop":
                flags |= ARTICLE if value.strip() == "articleBody" else 0
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                flags |= OUT
            elif key == "style":
                flags |= OUT if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) else 0
            elif key in ("class", "id"):
                plain = _QUALIFIED.sub(" ", value)
                words += [w.lower() for w in _SPLIT.split(f"{plain} {_CAMEL.sub(' ', plain)}") if w]
    if name in _LEFT_OUT or not _WORDS.isdisjoint(words):
        flags |= OUT
    if name == "form":
        flags |= OUT_UNLESS
    if name == "header" or ("header" in words and _OWN.isdisjoint(words) and name not in _HEADINGS):
        flags |= HEADER
    if name == "article":
        flags |= ARTICLE
    if name == "main":
        flags |= MAIN
    if name in ("html", "body"):
        flags = 0
    tag = _SPLIT.sub("", name) + ("" if name not in _HEADINGS else name[1])
    return ".".join([tag or "x", str(flags), *dict.fromkeys(words)])


def _text(pieces: list[str]) -> str:
    whole = "".join([html.unescape(piece) if "&" in piece else piece for piece in pieces])
    return " ".join(whole.split())


def parse(page: str) -> tuple[str, list[int], list[str]]:
    """(shape, nodes, texts): the shape, and of every block the place of its node in the shape and its text.

    A shape is its nodes' ``depth:label`` in order, separated by spaces. In a block, character
    references are decoded and white space (of any script) is one space; blocks without any other character are left out.
    """
    labels, kids = [""], [[]]
    tags, holders, opened = ["#"], [0], {}
    owners: list[int] = []
    texts: list[str] = []
    pieces: list[str] = []
    muted, muted_times, muted_level = "", 0, 0

    def flush() -> None:
        if pieces:
            if text := _text(pieces):
                owners.append(holders[-1])
                texts.append(text)
            pieces.clear()

    def pop_to(level: int) -> None:
        for tag in tags[level:]:
            opened[tag] -= 1
        del tags[level:], holders[level:]

    at = 0
    for match in _TOKEN.finditer(page):
        begin = match.start()
        if begin > at and not muted:
            pieces.append(page[at:begin])
        at = match.end()
        name = match["name"] or match["name2"]
        if name is None:
            continue
        name = name.lower()
        ending = match["end"] or match["end2"]
        attrs = match["attrs"] or match["attrs2"] or ""
        if name in INLINE:
            if muted:
                if name == muted and name not in _VOID:
                    muted_times += -1 if ending else 1
                    if not muted_times:
                        muted = ""
            elif name == "br":
                pieces.append(" ")
            elif not ending and attrs and name not in _VOID and _TELLING.search(attrs) and int(label_of(name, attrs).split(".")[1]) & OUT:
                muted, muted_times, muted_level = name, 1, len(tags)
            continue
        flush()
        if ending:
            if opened.get(name):
                level = len(tags) - 1
                while tags[level] != name:
                    level -= 1
                pop_to(level)
                if muted and len(tags) < muted_level:
                    muted = ""
            continue
        if opened.get("head") and name not in _IN_HEAD:
            pop_to(tags.index("head"))
        if name in _CLOSES_P and opened.get("p"):
            level = len(tags) - 1
            while tags[level] != "p":
                level -= 1
            pop_to(level)
        if name in _HEADINGS and tags[-1] in _HEADINGS:
            pop_to(len(tags) - 1)
        if name in _ENDS:
            ended, within = _ENDS[name]
            if any(opened.get(tag) for tag in ended):
                level = len(tags) - 1
                while level and tags[level] not in ended and tags[level] not in within:
                    level -= 1
                if tags[level] in ended:
                    pop_to(level)
        if muted and len(tags) < muted_level:
            muted = ""
        if name in _VOID:
            continue
        holder = holders[-1]
        if len(tags) < DEPTH:
            label = label_of(name, attrs)
            siblings = kids[holder]
            if siblings and labels[siblings[-1]] == label:
                holder = siblings[-1]
            else:
                labels.append(label)
                kids.append([])
                siblings.append(len(labels) - 1)
                holder = len(labels) - 1
        tags.append(name)
        holders.append(holder)
        opened[name] = opened.get(name, 0) + 1
    if at < len(page) and not muted:
        pieces.append(page[at:])
    flush()

    place, order, pending = {}, [], [(0, 0)]
    while pending:
        node, depth = pending.pop()
        place[node] = len(order)
        order.append(f"{depth}:{labels[node]}")
        pending += [(kid, depth + 1) for kid in reversed(kids[node])]
    return " ".join(order), [place[node] for node in owners], texts


@lru_cache(maxsize=1 << 12)
def tree_of(shape: str) -> tuple[list[str], list[list[int]], list[int]]:
    """(labels, children, parents) of a shape's nodes."""
    labels, kids, parents, path = [], [], [], []
    for entry in shape.split(" "):
        depth, _, label = entry.partition(":")
        del path[int(depth) :]
        parents.append(path[-1] if path else -1)
        if path:
            kids[path[-1]].append(len(labels))
        path.append(len(labels))
        labels.append(label)
        kids.append([])
    return labels, kids, parents


@lru_cache(maxsize=1 << 12)
def roles(shape: str) -> tuple[list[bool], list[int]]:
    """Of every node of a shape, whether it is left out, and whether it lies in an article (2), a main element (1) or neither (0)."""
    labels, kids, parents = tree_of(shape)
    flags = [int(label.split(".")[1]) if label else 0 for label in labels]
    holds = [bool(f & (ARTICLE | MAIN)) and not f & OUT for f in flags]
    holds_main = [bool(f & MAIN) and not f & OUT for f in flags]
    for node in range(len(labels) - 1, 0, -1):
        holds[parents[node]] |= holds[node]
        holds_main[parents[node]] |= holds_main[node]
    out, inside = [False], [0]
    for node in range(1, len(labels)):
        flag, parent = flags[node], parents[node]
        gone = out[parent] or (flag & OUT and not holds_main[node]) or (flag & OUT_UNLESS and not holds[node])
        gone = bool(gone or (flag & HEADER and not inside[parent] and not holds[node]))
        out.append(gone)
        own = 0 if gone else 2 if flag & ARTICLE else 1 if flag & MAIN else 0
        inside.append(max(inside[parent], own))
    return out, inside


@lru_cache(maxsize=1 << 12)
def aligned(shape: str, other: str) -> list[int]:
    """For every node of ``shape`` its counterpart in ``other``, or -1, by simple tree matching.

    Counterparts have the same label and matched parents, keep the order of siblings, and are as many as possible.
    """
    labels, kids, _ = tree_of(shape)
    if shape == other:
        return list(range(len(labels)))
    labels2, kids2, _ = tree_of(other)
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def weight(a: int, b: int) -> int:
        mine, others = kids[a], kids2[b]
        table = [[0] * (len(others) + 1)]
        for x in mine:
            above, row = table[-1], [0]
            for j, y in enumerate(others):
                both = above[j] + weight(x, y) if labels[x] == labels2[y] else 0
                row.append(max(above[j + 1], row[j], both))
            table.append(row)
        tables[a, b] = table
        return 1 + table[-1][-1]

    weight(0, 0)
    found = [-1] * len(labels)
    pending = [(0, 0)]
    while pending:
        a, b = pending.pop()
        found[a] = b
        table, i, j = tables[a, b], len(kids[a]), len(kids2[b])
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pending.append((kids[a][i], kids2[b][j]))
    return found
