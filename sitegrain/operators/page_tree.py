"""Element trees of HTML pages, built as browsers build them.

Tokens go through the standard's insertion modes with a stack of open elements and a list of active formatting elements: missing html, head,
body, tbody and tr elements are implied, misnested formatting is taken apart and reopened, and text or elements that a table
can't hold are put before it. Scripting counts as enabled, so ``noscript`` is raw text. Foreign content (svg, math) closes its own
empty elements and ends at an HTML block.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select"
    " source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing form h1 h2 h3 h4 h5 h6"
    " li dd dt plaintext table hr xmp".split()
)
BLOCK_ENDS = CLOSES_P - HEADINGS - {"p", "li", "dd", "dt", "plaintext", "table", "hr", "xmp"} | {"button"}
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
ITEM_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset(("html", "table", "template"))
SELECT_SCOPE = TABLE_SCOPE | {"td", "th"}
ROW_GROUPS, CELLS = frozenset(("tbody", "thead", "tfoot")), frozenset(("td", "th"))
TABLE_PARTS = ROW_GROUPS | CELLS | {"tr", "caption", "colgroup", "col"}
FOSTERING = ROW_GROUPS | {"table", "tr"}
MARKED = frozenset(("applet", "marquee", "object"))
FOREIGN, INTEGRATION = frozenset(("svg", "math")), frozenset(("foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"))
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

#: Open elements at most; an element within so many holds nothing, and what follows it belongs to the one around it. Browsers do alike.
DEPTH = 512
RARE = FOREIGN | {"select"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW | ESCAPABLE}


class Element:
    __slots__ = ("tag", "raw", "children", "parent", "_attributes")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children, self.parent, self._attributes = tag, raw, [], None, None

    @property
    def attributes(self) -> dict[str, str]:
        """Attributes by lower-case name, the first of equal names."""
        if self._attributes is None:
            self._attributes = {}
            for name, double, single, bare in _ATTRIBUTE.findall(self.raw):
                value = double or single or bare
                self._attributes.setdefault(name.lower(), unescape(value) if "&" in value else value)
        return self._attributes

    def add(self, child: Element | str, at: int | None = None) -> None:
        if isinstance(child, Element):
            child.parent = self
        if at is None:
            self.children.append(child)
        else:
            self.children.insert(at, child)

    def place_of(self, child: Element) -> int:
        return next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is child)


class Builder:
    def __init__(self) -> None:
        self.root = Element("#document")
        self.html, self.head, self.body = Element("html"), Element("head"), None
        self.root.add(self.html)
        self.html.add(self.head)
        self.stack: list[Element] = [self.html]
        self.active: list[Element | None] = []  # None is a marker
        self.form: Element | None = None
        self.met: set[str] = set()  # elements that most pages lack, of those begun

    # the stack of open elements

    def in_scope(self, tags, boundary=SCOPE) -> bool:
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in boundary:
                return False
        return False

    def pop_through(self, tags) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().tag in tags:
                return

    def pop_to(self, tags) -> None:
        while len(self.stack) > 1 and self.stack[-1].tag not in tags:
            self.stack.pop()

    def imply_ends(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope(("p",), BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_through(("p",))

    def start_body(self, raw: str = "") -> None:
        if self.body is None:
            del self.stack[1:]
            self.body = Element("body", raw)
            self.html.add(self.body)
            self.stack.append(self.body)

    # insertion

    def place(self, child: Element | str, target: Element | None = None) -> None:
        """Into the target, or before the innermost table if the target can't hold it."""
        target = target or self.stack[-1]
        if target.tag in FOSTERING and not (isinstance(child, Element) and child.tag in ("script", "style", "template")):
            at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == "table"), None)
            if at is not None:
                table = self.stack[at]
                if table.parent is not None:
                    table.parent.add(child, table.parent.place_of(table))
                else:
                    self.stack[at - 1].add(child)
                return
        target.add(child)

    def insert(self, element: Element, fostered: bool = True) -> Element:
        if fostered:
            self.place(element)
        else:
            self.stack[-1].add(element)
        if element.tag in RARE:
            self.met.add(element.tag)
        if element.tag not in VOID and len(self.stack) < DEPTH:
            self.stack.append(element)
        return element

    # active formatting elements

    def reopen(self) -> None:
        """Opens again the formatting elements that were closed by others."""
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self.insert(Element(self.active[k].tag, self.active[k].raw))

    def remember(self, element: Element) -> None:
        """As an active formatting element; of equal ones after the last marker the last three stay."""
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                break
            if self.active[i].tag == element.tag and self.active[i].raw == element.raw:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(element)

    def forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def active_named(self, tag: str) -> Element | None:
        for e in reversed(self.active):
            if e is None:
                return None
            if e.tag == tag:
                return e
        return None

    def take_apart(self, tag: str) -> None:
        """The standard's adoption agency: ends a formatting element whose content closes in another order."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            formatting = self.active_named(tag)
            if formatting is None:
                self.end_other(tag)
                return
            if formatting not in self.stack:
                self.active.remove(formatting)
                return
            if not self.in_scope((tag,)):
                return
            at = self.stack.index(formatting)
            furthest = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in SPECIAL), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(formatting)
                return
            block, ancestor = self.stack[furthest], self.stack[at - 1]
            bookmark = self.active.index(formatting)
            last, inner = block, 0
            for i in range(furthest - 1, at, -1):
                node = self.stack[i]
                inner += 1
                if inner > 3 and node in self.active:
                    gone = self.active.index(node)
                    bookmark -= gone < bookmark
                    del self.active[gone]
                if node not in self.active:
                    del self.stack[i]
                    continue
                copy = Element(node.tag, node.raw)
                copied = self.active.index(node)
                self.active[copied] = self.stack[i] = copy
                if last is block:
                    bookmark = copied + 1
                self.move(last, copy)
                last = copy
            if last.parent is not None:
                last.parent.children.remove(last)
                last.parent = None
            self.place(last, ancestor)
            copy = Element(formatting.tag, formatting.raw)
            for child in block.children:
                copy.add(child)
            block.children = []
            block.add(copy)
            gone = self.active.index(formatting)
            del self.active[gone]
            self.active.insert(bookmark - (gone < bookmark), copy)
            self.stack.remove(formatting)
            self.stack.insert(self.stack.index(block) + 1, copy)

    def move(self, child: Element, to: Element) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        to.add(child)

    # tokens

    def text(self, data: str) -> None:
        blank = not data.strip(" \t\n\r\f")
        if self.body is None:
            if blank:
                return
            self.start_body()
        if blank:
            self.stack[-1].add(data)
            return
        self.reopen()
        self.place(data)

    def whole(self, tag: str, raw: str, data: str) -> None:
        """An element of raw text."""
        element = Element(tag, raw)
        if data:
            element.add(data)
        if self.body is None and tag in IN_HEAD | {"title"}:
            (self.stack[-1] if len(self.stack) > 1 else self.head).add(element)
            return
        self.start_body()
        if tag == "xmp":
            self.close_p()
        if tag in ("xmp", "textarea"):
            self.reopen()
        self.place(element)

    def foreign(self) -> bool:
        """Whether the current element is svg, math or inside of one, and no place for HTML."""
        if self.met.isdisjoint(FOREIGN):
            return False
        for e in reversed(self.stack):
            if e.tag in INTEGRATION and any(x.tag in FOREIGN for x in self.stack):
                return False
            if e.tag in FOREIGN:
                return True
        return False

    def start(self, tag: str, raw: str) -> None:
        closed = raw.rstrip().endswith("/")
        if tag == "html":
            self.html.raw += " " + raw
            self.html._attributes = None
            return
        if self.body is None:
            if tag == "head":
                if len(self.stack) == 1:
                    self.head.raw = raw
                    self.stack.append(self.head)
                return
            if tag == "body":
                self.start_body(raw)
                return
            if tag in IN_HEAD:
                element = Element(tag, raw)
                self.head.add(element)
                return
            self.start_body()
        if tag in ("head", "frameset", "frame"):
            return
        if tag == "body":
            self.body.raw += " " + raw
            self.body._attributes = None
            return
        if self.foreign():
            if tag not in BREAKS_OUT:
                self.stack[-1].add(element := Element(tag, raw))
                if not closed and len(self.stack) < DEPTH:
                    self.stack.append(element)
                return
            while self.foreign():
                self.stack.pop()
        if "select" in self.met and self.in_scope(("select",), SELECT_SCOPE):
            if tag in ("select", "input", "keygen", "textarea"):
                self.pop_through(("select",))
                if tag == "select":
                    return
            elif tag in TABLE_PARTS | {"table"}:
                self.pop_through(("select",))
            elif tag in ("option", "optgroup", "hr"):
                if self.stack[-1].tag == "option":
                    self.stack.pop()
                if tag != "option" and self.stack[-1].tag == "optgroup":
                    self.stack.pop()
                self.insert(Element(tag, raw), False)
                return
            else:
                return
        if tag in TABLE_PARTS:
            self.table_part(tag, raw)
            return
        if tag == "table" and self.stack[-1].tag in FOSTERING:
            self.pop_through(("table",))
        if tag == "form" and self.form is not None:
            return
        if tag in CLOSES_P:
            if tag == "li":
                self.close_item(("li",))
            elif tag in ("dd", "dt"):
                self.close_item(("dd", "dt"))
            self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
        elif tag == "button":
            if self.in_scope(("button",)):
                self.imply_ends()
                self.pop_through(("button",))
            self.reopen()
        elif tag == "a":
            if (old := self.active_named("a")) is not None:
                self.take_apart("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
            self.reopen()
        elif tag == "nobr":
            self.reopen()
            if self.in_scope(("nobr",)):
                self.take_apart("nobr")
                self.reopen()
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            self.reopen()
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope(("ruby",)):
                self.imply_ends("rtc" if tag in ("rp", "rt") else "")
        elif tag not in IN_HEAD and tag not in ("param", "source", "track"):
            self.reopen()
        hidden = tag == "input" and self.stack[-1].tag in FOSTERING and 'hidden' in raw.lower()
        element = self.insert(Element(tag, raw), not hidden)
        if tag == "form":
            self.form = element
        if tag in FORMATTING:
            self.remember(element)
        elif tag in MARKED:
            self.active.append(None)
        elif tag in FOREIGN and closed and self.stack[-1] is element:
            self.stack.pop()

    def close_item(self, tags) -> None:
        for e in reversed(self.stack):
            if e.tag in tags:
                self.imply_ends(e.tag)
                self.pop_through((e.tag,))
                return
            if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str, raw: str) -> None:
        if not self.in_scope(("table",), frozenset(("html", "template"))):
            return
        if self.in_scope(CELLS | {"caption"}, TABLE_SCOPE):
            self.imply_ends()
            self.pop_through(CELLS | {"caption"})
            self.forget_to_marker()
        if tag in CELLS:
            self.pop_to({"tr", "table", "html"} | ROW_GROUPS)
            if self.stack[-1].tag != "tr":
                self.table_part("tr", "")
            self.insert(Element(tag, raw), False)
            self.active.append(None)
        elif tag == "tr":
            self.pop_to({"table", "html"} | ROW_GROUPS)
            if self.stack[-1].tag == "table":
                self.insert(Element("tbody"), False)
            self.insert(Element("tr", raw), False)
        elif tag == "col":
            self.pop_to({"table", "html", "colgroup"})
            if self.stack[-1].tag == "table":
                self.insert(Element("colgroup"), False)
            self.insert(Element("col", raw), False)
        else:
            self.pop_to({"table", "html"})
            self.insert(Element(tag, raw), False)
            if tag == "caption":
                self.active.append(None)

    def end_other(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.imply_ends(tag)
                del self.stack[i:]
                return
            if self.stack[i].tag in SPECIAL:
                return

    def end(self, tag: str) -> None:
        if self.body is None:
            if tag == "head":
                del self.stack[1:]
            elif tag == "br":
                self.start("br", "")
            return
        if tag in ("html", "body", "head"):
            return
        if self.foreign():
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    return
                if self.stack[i].tag in FOREIGN:
                    break
        if tag == "br":
            self.start("br", "")
        elif tag == "p":
            if not self.in_scope(("p",), BUTTON_SCOPE):
                self.insert(Element("p"))
            self.close_p()
        elif tag in ("table", "tr") or tag in ROW_GROUPS or tag in CELLS or tag == "caption":
            if self.in_scope((tag,), TABLE_SCOPE if tag != "table" else frozenset(("html", "template"))):
                if tag in CELLS or tag == "caption":
                    self.imply_ends()
                inside = len([e for e in self.stack if e.tag in CELLS or e.tag == "caption"])
                self.pop_through((tag,))
                for _ in range(inside - len([e for e in self.stack if e.tag in CELLS or e.tag == "caption"])):
                    self.forget_to_marker()
        elif tag == "li":
            if self.in_scope(("li",), ITEM_SCOPE):
                self.imply_ends("li")
                self.pop_through(("li",))
        elif tag in ("dd", "dt"):
            if self.in_scope((tag,)):
                self.imply_ends(tag)
                self.pop_through((tag,))
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_through(HEADINGS)
        elif tag == "select":
            if self.in_scope(("select",), TABLE_SCOPE):
                self.pop_through(("select",))
        elif tag == "form":
            self.form = None
            if self.in_scope(("form",)):
                self.imply_ends()
                self.pop_through(("form",))
        elif tag in BLOCK_ENDS or tag in MARKED:
            if self.in_scope((tag,)):
                self.imply_ends()
                self.pop_through((tag,))
                if tag in MARKED:
                    self.forget_to_marker()
        elif tag in FORMATTING:
            self.take_apart(tag)
        else:
            self.end_other(tag)


def ended_only(text: str) -> str:
    """The text with every ampersand written out that begins no character reference with a semicolon at its end."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), text)


def build(page: str, ended: bool = False) -> Element:
    """The document of a page; its only child is the html element.

    Browsers also read old names as references that lack their semicolon (``&amp`` before a tag). With ``ended`` these stay as they are written.
    """
    builder, at, size = Builder(), 0, len(page)
    written = (lambda s: ended_only(s) if "&" in s else s) if ended else (lambda s: s)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                builder.end(tag)
            elif (tag in RAW or tag in ESCAPABLE) and not builder.foreign():
                close = _RAW_END[tag].search(page, at)
                data = page[at : close.start() if close else size]
                builder.whole(tag, written(m[3]), unescape(written(data)) if tag in ESCAPABLE else data)
                if close:
                    past = page.find(">", close.end())
                    at = past + 1 if past >= 0 else size
                else:
                    at = size
            elif tag == "plaintext":
                builder.start(tag, written(m[3]))
                builder.text(page[at:])
                at = size
            else:
                builder.start(tag, written(m[3]))
            continue
        token = m[0]
        if token[0] != "<" or token == "<":
            builder.text(unescape(written(token)) if "&" in token else token)
    builder.start_body()
    return builder.root


def events(root: Element):
    """(element, None) at each start, (None, text) at each text and (element, end) at each end, in document order, without recursion."""
    pending: list[tuple[Element | str, bool]] = [(root, False)]
    while pending:
        node, ended = pending.pop()
        if isinstance(node, str):
            yield None, node
        elif ended:
            yield node, ""
        else:
            yield node, None
            pending.append((node, True))
            pending.extend((c, False) for c in reversed(node.children))
