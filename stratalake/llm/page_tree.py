"""One HTML page as a tree of elements and blocks of text: what a task does with a single row.

Tags need not be balanced: a block element closes an open paragraph, an item closes the item before it, an end tag closes
all that is open above its element, and one without an element is ignored.  An `article` or `main` inside an open menu
closes that menu.  An element is named by its path: tags with classes and ids (digits count alike), so all paragraphs of a
container are one node of the style tree; a container without a name has its place among its like instead.  Inline elements without a name that tells their role do not
appear in paths.  Paths end at DEPTH elements; deeper elements are merged with their ancestor there, and no text is lost.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

from xxhash import xxh3_64_intdigest

#: Elements of a path at most.
DEPTH = 48
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_words = lambda names: frozenset(names.split())

RAW = _words("script style textarea title xmp iframe noembed noframes")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td template tfoot th thead title tr ul"
)
#: A start tag closes an open element of these kinds, unless one of the kinds behind it lies between.
CLOSES = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr td th"), _words("table")),
    "td": (_words("td th"), _words("table tr")),
    "th": (_words("td th"), _words("table tr")),
    "tbody": (_words("tbody thead tfoot"), _words("table")),
    "tfoot": (_words("tbody thead tfoot"), _words("table")),
    "option": (_words("option"), _words("select")),
}
#: Kinds whose text is never an article's, whatever they hold.
NEVER = _words("head script style noscript template title iframe object embed svg canvas select option textarea button noembed noframes xmp audio video map")
#: Kinds whose text is none of the article's unless they hold the article itself.
ASIDE = _words("nav footer aside form dialog menu fieldset label search")
ROLES = _words("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist")
#: Words of classes and ids that name menus, notices, adverts and comments.
NAMED = _words(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay "
    "cookie cookies consent gdpr notice disclaimer alert toolbar sidebar aside rail widget widgets menu navbar nav navigation breadcrumb breadcrumbs "
    "pagination pager footer masthead topbar share sharing social related recommended recommendations teaser newsletter subscribe subscription signup "
    "login search comment comments commentlist respond reply replies discussion disqus talkback skip copyright outbrain taboola "
    "kommentar kommentare commentaires comentarios werbung anzeige publicite publicidad"
)
#: Words that tell the same inside longer ones (cookiebar, leftsidebar).
WITHIN = ("cookie", "advert", "sidebar", "comments", "newsletter", "breadcrumb", "popup", "sponsor", "consent", "navigation")
#: Names of a page's head, unless they speak of an article's.
HEADS, OF_ARTICLE = _words("header head topbar masthead"), _words("article post entry content story")
HOLDS = _words("article main")
#: Containers that are told apart by their place among their parent's children of the kind, if they have no name.
PLACED = _words("div section table tbody tr td center dl ul ol")


_TELLS = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MENUS, _HOLDERS, _P, _NO_P = _words("nav footer header ul ol p menu"), _words("article main aside section"), _words("p"), _words("table td th li button dd")


@lru_cache(1 << 14)
def _path(above: int, name: str, named: str) -> int:
    return xxh3_64_intdigest(f"{above} {name} {named}") >> 1


@lru_cache(1 << 12)
def _attributes(rest: str, top: bool) -> tuple[int, str, str, bool]:
    """noise, holds, the names of a start tag by its attributes, and whether they name the head of a page."""
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}
    role, named, noise = found.get("role", "").strip().lower(), f"{found.get('class', '')} {found.get('id', '')}", 0
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", "")):
        noise = 2
    words = [w.lower() for w in _NAME.findall(named)]
    if not noise and (role in ROLES or (not top and any(w in NAMED or any(x in w for x in WITHIN) for w in words))):
        noise = 1
    holds = "main" if role == "main" or found.get("itemprop", "").lower() == "articlebody" else ""
    heads = not top and not HEADS.isdisjoint(words) and OF_ARTICLE.isdisjoint(words)
    return noise, holds, " ".join(sorted({_DIGITS.sub("0", w).lower() for w in named.split()})), heads


class Page:
    """The elements (lists by number; 0 is the page itself) and blocks: (element, text, characters in links), in page order.

    noise: 2 for elements whose text never counts, 1 for those that are menus, notices, comments and the like by kind, role or name.
    """

    def __init__(self, source: str) -> None:
        self.parents, self.paths, self.kinds, self.noise, self.holds, self.plain, self.styles = [-1], [0], [""], [0], [""], [True], [0]
        self._depths, self._last = [0], [0]
        self._places: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int]] = [("", 0)]  # open elements: kind, and the number of the nearest one that is in paths
        self._text: list[str] = []
        self._links, self._linked, self._open_p = 0, 0, 0
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        self._believe()

    def _read(self, source: str) -> None:
        at = 0
        while match := _TAG.search(source, at):
            start, end = match.span()
            if at < start:
                self._say(source[at:start])
            at = end
            if (name := match["name"]) is None:
                continue
            name = name.lower()
            if match["end"]:
                self._end(name)
                continue
            self._start(name, match["rest"])
            if name in RAW:
                at = re.compile(f"</{name}(?=[\\s/>])|\\Z", re.IGNORECASE).search(source, at).start()
        if at < len(source):
            self._say(source[at:])
        self._break()

    def _say(self, said: str) -> None:
        if self.noise[self._stack[-1][1]] < 2:
            if "&" in said:
                said = html.unescape(said)
            self._text.append(said)
            if self._links:
                self._linked += len(said.strip())

    def _break(self) -> None:
        """A block of text ends here."""
        if self._text:
            if said := " ".join("".join(self._text).split()):
                self.blocks.append((self._stack[-1][1], said, min(self._linked, len(said))))
            self._text, self._linked = [], 0

    def _start(self, name: str, rest: str) -> None:
        block = name in BLOCK
        if block:
            self._break()
            if name in CLOSES:
                self._close(*CLOSES[name])
            if name in HOLDS:
                self._close(_MENUS, _HOLDERS)
            elif self._open_p and name != "br":
                self._close(_P, _NO_P)
        if name in VOID:
            return
        parent = self._stack[-1][1]
        noise, holds, named = self._judge(name, rest, parent)
        if block or noise:
            if not block:
                self._break()
            self._add(name, parent, noise, holds, named)
        else:
            self._stack.append((name, parent))
        self._links += name == "a"
        self._open_p += name == "p"

    def _judge(self, name: str, rest: str, parent: int) -> tuple[int, str, str]:
        noise, holds, named = 2 if name in NEVER else 1 if name in ASIDE else 0, name if name in HOLDS else "", ""
        if name == "header" and not self._inside(parent):
            noise = 1
        if _TELLS.search(rest):
            marked, holder, named, heads = _attributes(rest, name in ("html", "body"))
            noise, holds = max(noise, marked, int(heads and not self._inside(parent))), holds or holder
        return (2 if self.noise[parent] == 2 else noise), holds, named

    def _inside(self, node: int) -> bool:
        while node > 0:
            if self.holds[node]:
                return True
            node = self.parents[node]
        return False

    def _add(self, name: str, parent: int, noise: int, holds: str, named: str) -> None:
        plain = not named
        deep = self._depths[parent] >= DEPTH
        if not named and name in PLACED:
            named = str(at := self._places.get((parent, name), 0))
            self._places[parent, name] = at + 1
        path = self.paths[parent] if deep else _path(self.paths[parent], name, named)
        self.parents.append(parent)
        self.paths.append(path)
        self.kinds.append(name)
        self.noise.append(noise)
        self.holds.append(holds)
        self.plain.append(plain)
        self.styles.append(0)
        self._depths.append(self._depths[parent] + (not deep))
        self._last.append(0)
        if self._last[parent] != path:  # a run of like children counts once
            self._last[parent] = path
            self.styles[parent] = (self.styles[parent] * 1_000_003 ^ path) & (1 << 63) - 1
        self._stack.append((name, len(self.parents) - 1))

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._break()
        for i in range(len(self._stack) - 1, 0, -1):
            kind, node = self._stack[i]
            if kind == name:
                if name not in BLOCK and node != self._stack[i - 1][1]:
                    self._break()
                self._cut(i)
                return
            if name not in BLOCK and kind in BLOCK:
                return

    def _close(self, kinds: frozenset, stop: frozenset) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            kind = self._stack[i][0]
            if kind in kinds:
                self._cut(i)
            elif kind in stop:
                return

    def _cut(self, i: int) -> None:
        for kind, _ in self._stack[i:]:
            self._links -= kind == "a"
            self._open_p -= kind == "p"
        del self._stack[i:]

    def _believe(self) -> None:
        """Names tell menus and notices from the article unless the article stands inside such an element alone."""
        n = len(self.parents)
        covered, size, own = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            covered[i] = covered[self.parents[i]] + (self.noise[i] > 0)
        articles = [i for i in range(n) if self.holds[i] and self.noise[i] == 0]
        least = min((covered[i] for i in articles), default=0)
        if articles and not least:
            return
        for i in (i for i in articles if covered[i] == least):
            while i > 0 and not own[i]:
                own[i] = True
                i = self.parents[i]
        if not articles:
            for node, said, _ in self.blocks:
                size[node] += len(said)
            for i in range(n - 1, 0, -1):
                size[self.parents[i]] += size[i]
            own = [self.kinds[i] not in ASIDE - {"form"} and size[i] > 0.8 * size[0] for i in range(n)]
        for i in range(n):
            if own[i] and self.noise[i] == 1:
                self.noise[i] = 0

    def outside(self) -> list[bool]:
        """Elements in noise."""
        out = [False] * len(self.parents)
        for i in range(1, len(self.parents)):
            out[i] = out[self.parents[i]] or self.noise[i] > 0
        return out

    def holders(self) -> list[int]:
        """2 for elements in an article, 1 for those in a main element only, else 0."""
        held = [0] * len(self.parents)
        for i in range(1, len(self.parents)):
            held[i] = max(held[self.parents[i]], 2 * (self.holds[i] == "article"), 1 * bool(self.holds[i]))
        return held

    def inner(self) -> list[bool]:
        """Plain elements (paragraphs, headings, items and the like, without a name) inside an article or main element."""
        flow = [False] * len(self.parents)
        for i in range(1, len(self.parents)):
            p = self.parents[i]
            flow[i] = bool(self.holds[i]) or (flow[p] and self.plain[i])
        return flow
