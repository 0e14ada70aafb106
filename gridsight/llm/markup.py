"""HTML pages as trees of union-free expressions.

An expression node is an element key with an ordered list of children, each of which may be optional
(``?``) or repeated (``+``); ``#`` is a text slot and ``()`` a repeated group of several children. The
written form, e.g. ``body(nav(li+(#))article(h1(#)p+(#a?(#))))``, is the signature of a page.
"""

from __future__ import annotations

import html
import re

_TOKENS = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe)\b([^>]*)>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
                     re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
# Elements without content, and inline elements that only change how their text looks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PLAIN = frozenset("abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small strike strong sub sup time tt u var".split())
INLINE = PLAIN | frozenset("a span label".split())
# An opening tag that ends an open element of the given kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                    "pre section table ul li dd dt".split())
_BARRIER = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    """An expression: key, children, and whether it may be absent or repeated."""

    __slots__ = ("key", "kids", "optional", "many", "into", "number")

    def __init__(self, key: str, kids: list | None = None, optional: bool = False, many: bool = False):
        self.key, self.kids, self.optional, self.many = key, kids if kids is not None else [], optional, many
        self.into, self.number = None, -1

    def final(self) -> "Node":
        """The node that this one was merged into."""
        node = self
        while node.into is not None:
            node = node.into
        return node


def element_key(tag: str, attributes: str) -> str:
    """Tag and the words of class, id, role and itemprop, without digits, which often number pages."""
    words: list[str] = []
    if "=" in attributes:
        for _, *values in _NAMES.findall(attributes):
            words += re.findall(r"[a-z]+(?:[-_][a-z]+)*", "".join(values).lower())
    if attributes and _HIDDEN.search(attributes):
        words.append("hidden")
    return ".".join([tag, *dict.fromkeys(words)])


def parse(page: str) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The tree of a page, and its texts in page order as (slot, block, text); runs in one block share its number."""
    root = Node("page")
    stack: list[tuple[str, Node]] = [("page", root)]
    texts: list[tuple[Node, int, str]] = []
    block = at = 0

    def add(raw: str) -> None:
        if not raw:
            return
        if raw.isspace():
            if texts:
                texts.append((texts[-1][0], block, " "))
            return
        kids = stack[-1][1].kids
        if not kids or kids[-1].key != "#":
            kids.append(Node("#"))
        texts.append((kids[-1], block, html.unescape(raw)))

    for token in _TOKENS.finditer(page):
        add(page[at:token.start()])
        at = token.end()
        raw, _, closing, tag, attributes = token.groups()
        if raw or not tag:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "br" and texts:
                texts.append((texts[-1][0], block, " "))
            block += tag == "hr"
            continue
        plain = tag in PLAIN and (closing or "=" not in attributes)
        if tag not in INLINE:
            block += 1
        if plain and not any(t == tag for t, _ in stack[-1:]):
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in _ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] not in INLINE:
                    break
        ends, barrier = CLOSES.get(tag), _BARRIER.get(tag, ())
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in barrier:
                    break
                if stack[depth][0] in ends:
                    del stack[depth:]
                    if tag != "tr":
                        break
        node = Node(element_key(tag, attributes))
        stack[-1][1].kids.append(node)
        if not attributes.rstrip().endswith("/") or tag not in INLINE:
            stack.append((tag, node))
    add(page[at:])
    return root, texts


def fold(node: Node) -> Node:
    """Turn repeated children into repeated groups, from the leaves up."""
    for kid in node.kids:
        if kid.kids:
            fold(kid)
    node.kids = squeeze(node.kids)
    return node


def merge(left: Node, right: Node) -> Node:
    """The least expression of this kind that covers both; ``right`` is merged into ``left``."""
    if left is right:
        return left
    right.into = left
    left.optional |= right.optional
    left.many |= right.many
    if not left.kids and not right.kids:
        return left
    if len(left.kids) == len(right.kids) and all(a.key == b.key for a, b in zip(left.kids, right.kids)):
        for a, b in zip(left.kids, right.kids):
            merge(a, b)
        return left
    kids = []
    for a, b in align(left.kids, right.kids):
        if a is not None and b is not None:
            kids.append(merge(a, b))
        else:
            only = a if a is not None else b
            only.optional = True
            kids.append(only)
    left.kids = squeeze(kids)
    return left


def align(left: list[Node], right: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Pair equal keys in order, as many as can be; the rest stands alone."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i].key == right[j].key else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i].key == right[j].key:
            pairs.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            pairs.append((left[i], None))
            i += 1
        else:
            pairs.append((None, right[j]))
            j += 1
    return pairs


def squeeze(kids: list[Node], widest: int = 4) -> list[Node]:
    """Fold neighbours with equal keys into one repeated child, and repeated runs of children into a group."""
    out: list[Node] = []
    for kid in kids:
        if out and out[-1].key == kid.key and kid.key not in ("#", "()"):
            merge(out[-1], kid)
            out[-1].many = True
        elif out and out[-1].key == kid.key == "#":
            merge(out[-1], kid)
        else:
            out.append(kid)
    for width in range(2, min(widest, len(out) // 2) + 1):
        i = 0
        while i + 2 * width <= len(out):
            first, second = out[i:i + width], out[i + width:i + 2 * width]
            if all(a.key == b.key for a, b in zip(first, second)):
                for a, b in zip(first, second):
                    merge(a, b)
                group = Node("()", first, many=True)
                rest = i + 2 * width
                while rest + width <= len(out) and all(a.key == b.key for a, b in zip(first, out[rest:rest + width])):
                    for a, b in zip(first, out[rest:rest + width]):
                        merge(a, b)
                    rest += width
                out[i:rest] = [group]
            i += 1
    i = 0
    while i < len(out):
        # A run like a group's own, before or after it, is one more repetition.
        if out[i].key == "()":
            width = len(out[i].kids)
            for begin in (i + 1, i - width):
                run = out[begin:begin + width] if begin >= 0 else []
                if len(run) == width and all(a.key == b.key for a, b in zip(out[i].kids, run)):
                    for a, b in zip(out[i].kids, run):
                        merge(a, b)
                    del out[begin:begin + width]
                    i = max(0, min(i, begin) - 1)
                    break
        i += 1
    return out


def write(node: Node) -> str:
    """The written form; also numbers the text slots in its order."""
    count = 0

    def walk(one: Node) -> str:
        nonlocal count
        if one.key == "#":
            one.number, count = count, count + 1
        mark = "*" if one.optional and one.many else "?" if one.optional else "+" if one.many else ""
        return one.key.replace("(", "").replace(")", "") * (one.key != "()") + mark + (f"({''.join(map(walk, one.kids))})" if one.kids else "") + ("" if one.kids else ",")
    return walk(node)


_WRITTEN = re.compile(r"([^(),?+*]*)([?+*]?)([(,])|\)")


def read(text: str) -> Node:
    """The expression of a written form, its text slots numbered as in it."""
    top = Node("")
    stack, count = [top], 0
    for match in _WRITTEN.finditer(text):
        if match.group() == ")":
            stack.pop()
            continue
        key, mark, after = match.groups()
        node = Node(key or "()", [], mark in ("?", "*"), mark in ("+", "*"))
        if key == "#":
            node.number, count = count, count + 1
        stack[-1].kids.append(node)
        if after == "(":
            stack.append(node)
    return top.kids[0]


def flat(kids: list[Node]) -> list[Node]:
    """Children with those of groups in their place."""
    return [inner for kid in kids for inner in (flat(kid.kids) if kid.key == "()" else [kid])]


def slots(node: Node, path: tuple[str, ...] = (), repeated: bool = False) -> list[tuple[int, tuple[str, ...], bool]]:
    """Number and path of every text slot, and whether a page may hold it several times."""
    repeated |= node.many
    if node.key == "#":
        return [(node.number, path, repeated)]
    own = path if node.key == "()" else (*path, node.key)
    return [slot for kid in node.kids for slot in slots(kid, own, repeated)]


def match(page: Node, wrapper: Node) -> dict[int, int]:
    """For each text slot of a page's expression the slot of the wrapper that it fills; none if it fills no one.

    Children are paired in order so that the most slots are filled. A group's children are met as often
    as the page needs, so a run that begins or ends amid a repetition is covered as well.
    """
    if page.key == "#":
        return {page.number: wrapper.number}
    kids, items = flat(page.kids), wrapper.kids
    n, m = len(kids), len(items)
    by_key: list[dict[str, list[Node]]] = [{} for _ in items]
    for ways, item in zip(by_key, items):
        for kid in flat([item]):
            ways.setdefault(kid.key, []).append(kid)
    # What a child fills in an item; where the next child may begin: a group is not left by one match.
    fits = [[max((match(kid, b) for b in ways[kid.key]), key=len) if kid.key in ways else None for ways in by_key] for kid in kids]
    after = [j + (item.key != "()") for j, item in enumerate(items)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], -1 if fits[i][j] is None else best[i + 1][after[j]] + len(fits[i][j]))
    found: dict[int, int] = {}
    i = j = 0
    while i < n and j < m:
        if fits[i][j] is not None and best[i][j] == best[i + 1][after[j]] + len(fits[i][j]):
            found.update(fits[i][j])
            i, j = i + 1, after[j]
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return found
