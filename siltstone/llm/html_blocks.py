"""Leaf blocks of HTML pages: a tolerant tokenizer and block splitter with ancestor features."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict

from siltstone.llm.resident import cleaned

BITS = 16

# Fixed values of the HTML standard: elements by how they treat text.
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
UNSEEN = frozenset("head script style noscript template iframe noembed noframes svg math canvas object audio video select datalist textarea title map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag closes an open element of these names, no further out than the bounds.
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_TOKEN = re.compile(r"[a-z]+")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % ((1 << BITS) - 1) + 1


_known: dict[tuple[str, str], tuple[int, ...]] = {}
cleaned(_known.clear)


def _element(tag: str, attributes: str) -> tuple[int, ...]:
    """Features of being inside an element: its name, and the words of its class, id and role."""
    got = _known.get((tag, attributes))
    if got is None:
        words = dict.fromkeys(w for m in _ATTR.finditer(attributes) for w in _TOKEN.findall(html.unescape(m[2] or m[3] or m[4] or "").lower()))
        if len(_known) > 50_000:
            _known.clear()
        got = (_hash(f"in {tag}"), *(_hash(f"word {w}") for w in words))
        if len(attributes) < 500:
            _known[tag, attributes] = got
    return got


def _text_features(tag: str, text: str, linked: int, before: str) -> list[int]:
    n = len(text)
    words = text.count(" ") + 1
    share = linked / max(n, 1)
    ends = text[-1] in ".!?…:;\"”»)"
    out = [
        "bias",
        f"tag {tag}",
        f"words {min(6, words.bit_length())}",
        f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"ends {ends}",
        f"ends {ends} words {min(4, words.bit_length())}",
        f"before {before}",
        f"commas {min(3, text.count(','))}",
    ]
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    if "|" in text or "»" in text or "›" in text:
        out.append("bars")
    return [_hash(x) for x in out]


class _Ends:
    """Where tags of a page end: at the first ``>`` outside quotes. Each quote is looked at once, whatever the page."""

    def __init__(self, page: str):
        self.page, self.known, self.last = page, {}, page.rfind(">")

    def of(self, at: int) -> int:
        """The end of the tag whose attributes begin here; where its quotes do not close, the next ``>``."""
        page, i, passed = self.page, at, []
        while True:
            m = _SPECIAL.search(page, i)
            end = -1
            if m is None:
                break
            s = m.start()
            if s in self.known:
                end = self.known[s]
                break
            passed.append(s)
            if page[s] == ">":
                end = s
                break
            close = page.find(page[s], s + 1)
            if close < 0:
                break
            i = close + 1
        for s in passed:
            self.known[s] = end
        return end if end >= 0 else page.find(">", at)


class Blocks(list):
    """(text, own features) of the leaf blocks of a page, in order, and how the features of their ancestors come and go.

    ``changes`` has (block, feature, +1 or -1): from this block on, some open element has the feature, or none has it any more.
    Pages of any depth take space for each element once.
    """

    def __init__(self):
        super().__init__()
        self.changes: list[tuple[int, int, int]] = []

    def left(self) -> list[int]:
        """Features that are still there at the end."""
        total: Counter[int] = Counter()
        for _, f, sign in self.changes:
            total[f] += sign
        return [f for f, n in total.items() if n]

    def features(self) -> list[list[int]]:
        """All features of every block, each once."""
        out, inside, at = [], {}, 0
        for i, (_, own) in enumerate(self):
            while at < len(self.changes) and self.changes[at][0] <= i:
                _, f, sign = self.changes[at]
                if sign > 0:
                    inside[f] = True
                else:
                    del inside[f]
                at += 1
            out.append(list(dict.fromkeys(own) | inside))
        return out


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """(text, features) of the leaf blocks of a page, in order; space grows with the depth of the page, too."""
    found = leaf_blocks(page)
    return [(text, feats) for (text, _), feats in zip(found, found.features())]


def leaf_blocks(page: str) -> Blocks:
    """The leaf blocks of a page.

    A block is the text between two borders of block elements. White space in it, line breaks
    included, is one space. Unclosed and stray tags are taken as browsers do, as far as text goes.
    Time and space are linear in the page.
    """
    out = Blocks()
    stack: list[tuple[str, tuple[int, ...]]] = []
    holders: list[tuple[int, str]] = []  # the elements of the stack that are not inline, and their places
    open_: defaultdict[str, list[int]] = defaultdict(list)  # the places of each tag on the stack
    inside: Counter[int] = Counter()  # features of all ancestors, however deep, and how often
    parts: list[str] = []
    linked, unseen, before = 0, 0, "start"
    at, n, ends = 0, len(page), _Ends(page)

    def flush():
        nonlocal linked, before
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                block = holders[-1][1] if holders else "body"
                own = dict.fromkeys(_text_features(block, text, linked, before))
                out.append((text, [f for f in own if not inside[f]]))
                before = block
        linked = 0

    def push(tag: str, own: tuple[int, ...]) -> None:
        nonlocal unseen
        open_[tag].append(len(stack))
        unseen += tag in UNSEEN
        if tag not in INLINE:
            holders.append((len(stack), tag))
        stack.append((tag, own))
        for f in own:
            inside[f] += 1
            if inside[f] == 1:
                out.changes.append((len(out), f, 1))

    def pop():
        nonlocal unseen
        tag, own = stack.pop()
        open_[tag].pop()
        unseen -= tag in UNSEEN
        if tag not in INLINE:
            holders.pop()
        for f in own:
            inside[f] -= 1
            if not inside[f]:
                out.changes.append((len(out), f, -1))

    def close(names, bounds) -> None:
        i = max((open_[t][-1] for t in names if open_[t]), default=-1)
        if i < 0 or any(open_[t] and open_[t][-1] > i for t in bounds):
            return
        if holders and holders[-1][0] >= i:
            flush()
        while len(stack) > i:
            pop()

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            if open_["a"]:
                linked += len(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _OPEN.match(page, lt)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            add(page[at : lt + 1])  # a plain sign
            at = lt + 1
            continue
        add(page[at:lt])
        if page.startswith("<!--", lt):
            short = next((len(x) for x in ("<!-->", "<!--->") if page.startswith(x, lt)), 0)
            end = page.find("-->", lt + 4)
            at = lt + short if short else n if end < 0 else end + 3
            continue
        if lt > ends.last:
            break  # the page ends inside a tag
        if m is None:
            at = page.find(">", lt) + 1
            continue
        end = ends.of(m.end())
        tag, attributes, at = m[2].lower(), page[m.end() : end], end + 1
        if m[1]:
            if tag == "p" and not open_["p"]:
                flush()
            elif tag == "br":
                add(" ")
            else:
                close({tag}, () if tag not in INLINE else CLOSES_P - {"p"} | {"td", "th", "li", "body"})
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                add(" ")
            continue
        if tag in CLOSES_P:
            close({"p"}, {"button", "td", "th", "table", "caption", "object", "div", "article", "section", "li"})
        if tag == "body" or tag == "html":
            close({"head"}, ())
            if open_[tag]:
                continue
        if tag in SAME:
            close(*SAME[tag])
        if tag not in INLINE:
            flush()
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path", "circle", "use"):
            continue
        push(tag, _element(tag, attributes))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            at = n if end is None else end.start()
    flush()
    return out
