"""What the style sheets of a page do to ``display`` and ``visibility``, by the cascade of CSS.

Sheets are walked with their nesting. Rules in ``@media`` count if the query holds on a desktop screen of ``WIDTH`` by ``HEIGHT`` pixels. Importance,
layers, specificity and order decide between rules. Selectors are matched by one pass over the tree: each compound selector is a bit, and an
element has the bits of all selectors that end at it, so the work is elements times compounds however selectors are combined. Where it isn't known
whether a rule holds (``:has``, ``@container``, unknown pseudo-classes), it may show an element but not hide one. Pages are taken as just loaded: nothing is
hovered, focused or a target.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

# The screen that media queries are asked for, and keywords of CSS.
WIDTH, HEIGHT = 1280, 800
DISPLAYS = frozenset("""none inline block contents flow flow-root flex grid table inline-block inline-flex inline-grid inline-table list-item ruby math run-in table-row table-cell table-row-group
    table-header-group table-footer-group table-column table-column-group table-caption ruby-base ruby-text ruby-base-container ruby-text-container inherit initial unset revert revert-layer
    -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex -ms-flexbox -ms-grid -moz-box""".split())
SEEN = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())
WIDE = frozenset("inherit initial unset revert revert-layer".split())
NEVER = frozenset("""hover active focus focus-within focus-visible target target-within visited fullscreen modal popover-open autofill playing paused current past future host
    before after first-line first-letter user-invalid user-valid""".split())
FEATURES = {
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "prefers-color-scheme": "light",
    "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "prefers-reduced-transparency": "no-preference", "forced-colors": "none", "inverted-colors": "none",
    "display-mode": "browser", "update": "fast", "overflow-block": "scroll", "overflow-inline": "scroll", "scan": "progressive", "dynamic-range": "standard", "color-gamut": "srgb",
}
NUMBERS = {"width": WIDTH, "device-width": WIDTH, "height": HEIGHT, "device-height": HEIGHT, "aspect-ratio": WIDTH / HEIGHT, "device-aspect-ratio": WIDTH / HEIGHT, "resolution": 1, "-webkit-device-pixel-ratio": 1, "device-pixel-ratio": 1, "color": 8, "monochrome": 0, "color-index": 0, "grid": 0}
#: Rules in deeper or longer nests than any author's hide nothing, as it can't be told cheaply what they select.
DEEP, LONG = 30, 1_000_000
UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "pt": 4 / 3, "in": 96, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "vw": WIDTH / 100, "vh": HEIGHT / 100, "dppx": 1, "x": 1, "dpi": 1 / 96, "dpcm": 2.54 / 96}

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SHEET = re.compile(r"""\\.|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|\burl\([^)"']*+\)|[{};()\[\]]""", re.S | re.I)
_STRING = re.compile(r""""(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|\burl\([^)"']*+\)""", re.S | re.I)
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility|all)\s*:([^;]*)", re.I)
_NAME = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F]|[\w-]|[^\x00-\x7f])+"
_SIMPLE = re.compile(rf"""(?P<tag>(?:{_NAME}|\*)?\|?(?:{_NAME}|\*))|\#(?P<id>{_NAME})|\.(?P<class>{_NAME})|(?P<nest>&)|::?(?P<pseudo>{_NAME})(?P<open>\()?
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|{_NAME})\s*(?P<case>[iIsS])?\s*)?\]""", re.X)  # fmt: skip
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
_MAYBE = re.compile("style|hidden", re.I)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)


class Rule(NamedTuple):
    selector: str
    given: dict
    layer: float
    sure: bool


def declared(body: str) -> dict[str, tuple[str, bool]]:
    """The valid values of the three properties in a list of declarations, and whether they are important."""
    out: dict[str, tuple[str, bool]] = {}
    for m in _DECLARATION.finditer(_STRING.sub("", _COMMENT.sub("", body))):
        name, (value, mark, _) = m[1].lower(), m[2].lower().partition("!")
        words, important = value.split(), bool(mark) and m[2].lower().rpartition("!")[2].strip() == "important"
        if mark and not important or not words:
            continue
        known = "var(" in value or all(w in (DISPLAYS if name == "display" else SEEN if name == "visibility" else WIDE | {"visible", "hidden", "auto"} if name == "content-visibility" else WIDE) for w in words)
        for each in ("display", "visibility", "content-visibility") if name == "all" else (name,):
            if known and (important or not out.get(each, ("", False))[1]):
                out[each] = (" ".join(words), important)
    return out


def _number(text: str) -> float | None:
    m = re.fullmatch(r"([+-]?\d*\.?\d+)(?:\s*/\s*(\d*\.?\d+))?\s*([a-z]*)", text.strip(), re.A)
    return float(m[1]) / (float(m[2] or 1) or math.nan) * UNITS[m[3]] if m and m[3] in UNITS else None


def _feature(text: str) -> bool:
    """One feature of a media query, without its brackets."""
    text = text.strip().lower()
    name, colon, value = (s.strip() for s in text.partition(":"))
    if colon:
        edge, bare = re.match("(-webkit-)?(min-|max-)?", name)[2], re.sub("^(-webkit-)?(?:min-|max-)", r"\1", name)
        n = _number(value)
        if bare in NUMBERS and n is not None:
            return NUMBERS[bare] >= n if edge == "min-" else NUMBERS[bare] <= n if edge == "max-" else NUMBERS[bare] == n
        return FEATURES.get(name) == value
    parts = re.split(r"(<=|>=|<|>|=)", text)
    if len(parts) == 1:
        return bool(NUMBERS.get(text)) or FEATURES.get(text, "none") not in ("none", "no-preference")
    held = []
    for a, op, b in zip(parts[::2], parts[1::2], parts[2::2], strict=False):
        x, y = (NUMBERS.get(s.strip(), _number(s)) for s in (a, b))
        if x is None or y is None:
            return False
        held.append({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "=": x == y}[op])
    return all(held)


def _pieces(text: str, at: re.Pattern) -> list[str]:
    """``text`` split where ``at`` matches outside brackets and strings."""
    out, start, depth, i = [], 0, 0, 0
    while i < len(text):
        if m := _STRING.match(text, i):
            i = m.end()
            continue
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] in "([") - (text[i] in ")]")
        if depth == 0 and (m := at.match(text, i)) and m.end() > i:
            out.append(text[start:i])
            start = i = m.end()
            continue
        i += 1
    return [*out, text[start:]]


_COMMA, _AND, _OR = re.compile(","), re.compile(r"\s+and\s+|(?<=\))and\b\s*", re.I), re.compile(r"\s+or\s+", re.I)


def _condition(text: str) -> bool:
    text = text.strip()
    if len(parts := _pieces(text, _OR)) > 1:
        return any(map(_condition, parts))
    if len(parts := _pieces(text, _AND)) > 1:
        return all(map(_condition, parts))
    if m := re.match(r"not\b\s*(?=\()", text, re.I):
        return not _condition(text[m.end() :])
    if text.startswith("(") and text.endswith(")"):
        inner = text[1:-1].strip()
        return _condition(inner) if inner.startswith("(") or re.match(r"not\b", inner, re.I) else _feature(inner)
    return text.lower() in ("screen", "all")


def on_screen(query: str) -> bool:
    """Whether a list of media queries holds on the screen."""
    if not query.strip():
        return True
    for part in _pieces(query, _COMMA):
        part = re.sub(r"^\s*only\s+", "", part, flags=re.I).strip()
        m = re.match(r"not\s+(?=[a-z])", part, re.I)
        if part.count("(") <= DEEP and part and (not _condition(part[m.end() :]) if m else _condition(part)):
            return True
    return False


class Sheets:
    """Rules of style sheets, in order."""

    def __init__(self) -> None:
        self.rules: list[Rule] = []
        self.layers: dict[str, int] = {}

    def layer(self, name: str) -> int:
        return self.layers.setdefault(name, len(self.layers))

    def read(self, text: str) -> None:
        text = _COMMENT.sub(lambda m: " " if m[0][0] == "/" else "", text)
        # (selector above, layer, certain, taken) of the open blocks, and the start and pieces of their declarations
        stack: list[tuple[str | None, str | None, bool, bool]] = [(None, None, True, True)]
        bodies: list[list[str]] = [[]]
        start, depth = 0, 0

        def done() -> None:
            above, layer, sure, taken = stack.pop()
            if (body := bodies.pop()) and above is not None and taken and (given := declared(";".join(body))):
                self.rules.append(Rule(above, given, math.inf if layer is None else self.layer(layer), sure))

        for m in _SHEET.finditer(text):
            c = m[0]
            if c in ("(", "["):
                depth += 1
            elif c in (")", "]"):
                depth = max(0, depth - 1)
            elif c == ";" and depth == 0:
                piece = text[start : m.start()].strip()
                if (named := re.match(r"@layer\s+(.*)", piece, re.I | re.S)) and stack[-1][3]:
                    for name in named[1].split(","):
                        self.layer(".".join(filter(None, (stack[-1][1], name.strip()))))
                elif not piece.startswith("@"):
                    bodies[-1].append(piece)
                start = m.end()
            elif c == "{":
                head, depth = text[start : m.start()].strip(), 0
                above, layer, sure, taken = stack[-1]
                if head.startswith("@"):
                    at = re.match(r"@([\w-]*)\s*(.*)", head, re.S)
                    kind, rest = at[1].lower(), at[2]
                    if kind == "media":
                        taken = taken and on_screen(rest)
                    elif kind == "layer":
                        layer = ".".join(filter(None, (layer, rest.strip() or f"<{len(self.layers)}>")))
                        self.layer(layer)
                    elif kind == "supports":
                        taken = taken and not re.match(r"not\b", rest.strip(), re.I)
                    elif kind in ("container", "scope"):
                        sure = False
                    else:
                        taken = False
                    stack.append((above, layer, sure, taken))
                else:
                    if len(stack) > DEEP or len(above or "") * head.count("&") > LONG:
                        head, taken = "", False
                    elif above is not None:
                        head = ",".join(p.replace("&", f":is({above})") if "&" in p else f":is({above}) {p}" for p in _pieces(head, _COMMA))
                    stack.append((head, layer, sure, taken))
                bodies.append([])
                start = m.end()
            elif c == "}":
                bodies[-1].append(text[start : m.start()])
                depth = 0
                if len(stack) > 1:
                    done()
                else:
                    bodies[-1].clear()
                start = m.end()
        bodies[-1].append(text[start:])
        while len(stack) > 1:
            done()


class State(NamedTuple):
    """Selectors that end at an element, at one above it, at one before it, and at any before it."""

    own: int
    above: int


class Cascade:
    """Compound selectors as bits and what the elements that have them get."""

    def __init__(self, sheets: Sheets) -> None:
        self.compounds: list[list[tuple]] = []  # tests; the compound to the left has the bit before
        self.by_key: dict[tuple[str, str], int] = {}
        self.after = {"": 0, " ": 0, ">": 0, "+": 0, "~": 0}  # compounds by their combinator with the one to the left
        self.ends: dict[int, list[tuple]] = {}
        for order, rule in enumerate(sheets.rules):
            found = self.compiled(rule.selector)
            for bit, specificity, sure in found or ():
                for name, (value, important) in rule.given.items():
                    layer = -rule.layer if important else rule.layer
                    if rule.sure and sure or not hides(name, value):
                        self.ends.setdefault(bit, []).append((name, (important, False, layer, specificity, order), value))

    def compiled(self, text: str, lenient: bool = False) -> list[tuple[int, tuple, bool]] | None:
        """The last bit, specificity and certainty of each selector in a list; None if one isn't valid."""
        if text.count("(") > 4 * DEEP:
            return None
        out = []
        for part in _pieces(text, _COMMA):
            one = self.complex(part.strip())
            if one is None and not lenient:
                return None
            if one is not None:
                out.append(one)
        return out

    def complex(self, text: str) -> tuple[int, tuple, bool] | None:
        at, combinator, before, weight, sure, parts = 0, "", -1, (0, 0, 0), True, []
        tests: list[tuple] = []
        while at <= len(text):
            if at < len(text) and (m := _SIMPLE.match(text, at)) and not (m["tag"] and tests):
                at = m.end()
                inner = None
                if m["open"]:
                    stop = depth = 1
                    end = at
                    while end < len(text) and depth:
                        if s := _STRING.match(text, end):
                            end = s.end()
                            continue
                        depth += (text[end] == "(") - (text[end] == ")")
                        end += 2 if text[end] == "\\" else 1
                    inner, at = text[at : end - stop], end
                got = self.simple(m, inner)
                if got is None:
                    return None
                test, w, known = got
                tests.append(test)
                weight, sure = tuple(a + b for a, b in zip(weight, w, strict=True)), sure and known
                continue
            if not tests:
                return None
            parts.append((tests, combinator))
            if at == len(text):
                break
            m = _COMBINATOR.match(text, at)
            if not m or m.end() == len(text):
                return None
            combinator, at, tests = m[1] or " ", m.end(), []
        for tests, combinator in parts:
            self.compounds.append(tests)
            before = len(self.compounds) - 1
            self.after[combinator] |= 1 << before
            keyed = {t[0]: t for t in tests if t[0] in ("id", "class", "tag") and t[1] != "*"}
            key = next((keyed[k] for k in ("id", "class", "tag") if k in keyed), ("tag", "*"))
            self.by_key[key[:2]] = self.by_key.get(key[:2], 0) | 1 << before
        return before, weight, sure

    def simple(self, m: re.Match, inner: str | None) -> tuple[tuple, tuple, bool] | None:
        if m["tag"]:
            name = plain(m["tag"].rpartition("|")[2]).lower()
            return ("tag", name), (0, 0, int(name != "*")), True
        if m["id"]:
            return ("id", plain(m["id"])), (1, 0, 0), True
        if m["class"]:
            return ("class", plain(m["class"])), (0, 1, 0), True
        if m["attr"]:
            value = m["value"] or ""
            value = plain(value[1:-1] if value[:1] in "\"'" else value)
            return ("attr", plain(m["attr"]).lower(), m["op"], value.lower() if (m["case"] or "") in ("i", "I") else value, (m["case"] or "") in ("i", "I")), (0, 1, 0), True
        if m["nest"]:
            return ("root",), (0, 0, 0), True
        name, legacy = m["pseudo"].lower(), m[0].startswith("::")
        if legacy or name in NEVER:
            return ("never",), (0, 1, 0), True
        if name in ("is", "where", "not", "matches", "-webkit-any", "-moz-any") and inner is not None:
            found = self.compiled(inner, name != "not")
            if found is None:
                return None
            most = max((f[1] for f in found), default=(0, 0, 0)) if name != "where" else (0, 0, 0)
            return ("not" if name == "not" else "is", sum(1 << b for b in {f[0] for f in found})), most, all(f[2] for f in found)
        nth = {"first-child": "1", "last-child": "1", "first-of-type": "1", "last-of-type": "1"}.get(name) or (inner if name.startswith("nth-") else None)
        if nth is not None and " of " not in nth:
            n = re.sub(r"\s+", "", nth.lower()).replace("even", "2n").replace("odd", "2n+1")
            f = re.fullmatch(r"(?:([+-]?[0-9]{0,9})n)?([+-]?[0-9]{1,9})?", n)
            if not f or not n:
                return None
            a = 0 if f[1] is None else int(f[1] + "1" if f[1] in ("", "+", "-") else f[1])
            return ("nth", a, int(f[2] or 0), "last" in name, "type" in name), (0, 1, 0), True
        if name in ("root", "scope", "empty", "only-child", "only-of-type", "checked", "disabled", "enabled", "link", "any-link", "open", "defined", "read-only"):
            return (name,), (0, 1, 0), name != "read-only"
        return ("unknown",), (0, 1, 0), False

    def matched(self, e, attributes: dict, place: tuple, parent: State, before: int, earlier: int) -> int:
        """The bits of an element. ``before`` are those of the sibling before it, ``earlier`` those of all before it."""
        classes = (attributes.get("class") or "").split()
        near = self.by_key.get(("tag", "*"), 0) | self.by_key.get(("tag", e.tag), 0) | self.by_key.get(("id", attributes.get("id")), 0)
        for c in classes:
            near |= self.by_key.get(("class", c), 0)
        after, own = self.after, 0
        near &= after[""] | after[" "] & (parent.above | parent.own) << 1 | after[">"] & parent.own << 1 | after["+"] & before << 1 | after["~"] & earlier << 1
        for bit in bits_of(near):
            if all(self.test(t, e, attributes, classes, place, own) for t in self.compounds[bit]):
                own |= 1 << bit
        return own

    def test(self, t: tuple, e, attributes: dict, classes: list[str], place: tuple, own: int) -> bool:
        kind = t[0]
        if kind == "tag":
            return t[1] in ("*", e.tag)
        if kind == "class":
            return t[1] in classes
        if kind == "id":
            return attributes.get("id") == t[1]
        if kind == "attr":
            value = attributes.get(t[1])
            if value is None or t[2] is None:
                return value is not None
            value, want = value.lower() if t[4] else value, t[3]
            if t[2] in ("^=", "$=", "*=") and not want:
                return False
            return {"=": value == want, "~=": want in value.split(), "|=": value == want or value.startswith(want + "-"), "^=": value.startswith(want), "$=": value.endswith(want), "*=": want in value}[t[2]]
        if kind in ("is", "not"):
            return bool(own & t[1]) == (kind == "is")
        if kind == "nth":
            i = place[2 * t[4] + t[3]] - t[2]
            return i == 0 if t[1] == 0 else i % t[1] == 0 and i // t[1] >= 0
        if kind in ("only-child", "only-of-type"):
            at = 2 * (kind == "only-of-type")
            return place[at] == place[at + 1] == 1
        if kind in ("root", "scope"):
            return e.tag == "html"
        if kind == "empty":
            return not e.children
        if kind == "checked":
            return "checked" in attributes or e.tag == "option" and "selected" in attributes
        if kind in ("disabled", "enabled"):
            return e.tag in ("button", "input", "select", "textarea", "option", "optgroup", "fieldset") and ("disabled" in attributes) == (kind == "disabled")
        if kind in ("link", "any-link"):
            return e.tag in ("a", "area") and "href" in attributes
        if kind == "open":
            return "open" in attributes
        return kind != "never"


def bits_of(own: int) -> Iterator[int]:
    while own:
        low = own & -own
        yield low.bit_length() - 1
        own ^= low


def plain(name: str) -> str:
    """A name or string without escapes."""
    return _ESCAPE.sub(lambda m: (chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "\ufffd") if m[1] else m[2], name) if "\\" in name else name


def hides(name: str, value: str) -> bool:
    return value == "none" if name == "display" else value in ("hidden", "collapse")


def _attributes(e) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(e.attributes):
        out.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return out


def sheets_of(root) -> Sheets:
    """The sheets of the page's style elements that count on a screen, in the order of the page."""
    sheets, waiting = Sheets(), [root]
    while waiting:
        e = waiting.pop()
        if e.tag == "style":
            given = _attributes(e)
            if on_screen(given.get("media", "")) and given.get("type", "text/css").strip().lower() in ("", "text/css"):
                sheets.read("".join(map(str, e.children)))
        elif e.tag != "template":
            waiting.extend(c for c in reversed(e.children) if not isinstance(c, str))
    return sheets


def drop_unshown(root, kind, styled: bool) -> None:
    """Takes out of the tree below ``root`` what isn't displayed, and the texts of elements that aren't visible. ``kind`` is the class of elements."""
    cascade = Cascade(sheets_of(root)) if styled else None
    if cascade and not cascade.ends:
        cascade = None
    nothing = State(0, 0)
    bare = lambda tag, above: State(cascade.matched(kind(tag), {}, (1, 1, 1, 1), above, 0, 0), above.own | above.above)
    state, tags = nothing, set()
    if cascade:
        waiting = [root]
        while waiting:
            e = waiting.pop()
            tags.add(e.tag)
            waiting.extend(c for c in e.children if isinstance(c, kind) and e.tag in ("#root", "html"))
        state = nothing if "html" in tags else bare("html", nothing)
    waiting_for: list[tuple] = [(root, state, True)]
    while waiting_for:
        e, state, visible = waiting_for.pop()
        kids = [c for c in e.children if isinstance(c, kind)]
        before = earlier = 0
        count: dict[str, int] = {}
        total: dict[str, int] = {}
        left = set()
        inside: dict[str, State] = {}
        if cascade:
            for c in kids:
                total[c.tag] = total.get(c.tag, 0) + 1
        for i, c in enumerate(kids):
            own, parent = 0, state
            if not cascade and not c.attributes:
                waiting_for.append((c, state, visible))
                continue
            given = _attributes(c) if c.attributes and (cascade or _MAYBE.search(c.attributes)) else {}
            if cascade:
                count[c.tag] = n = count.get(c.tag, 0) + 1
                # elements that a browser puts in where their tags are left out
                lacking = "body" if e.tag in ("#root", "html") and "body" not in tags and c.tag not in ("html", "head") else "tbody" if e.tag == "table" and c.tag == "tr" else ""
                if lacking:
                    if lacking not in inside:
                        inside[lacking] = bare(lacking, state)
                    parent = inside[lacking]
                own = cascade.matched(c, given, (i + 1, len(kids) - i, n, total[c.tag] - n + 1), parent, before, earlier)
                before, earlier = own, earlier | own
            best: dict[str, tuple] = {}
            if cascade and own:
                for bit in bits_of(own):
                    for name, key, value in cascade.ends.get(bit, ()):
                        if name not in best or key >= best[name][0]:
                            best[name] = (key, value)
            if "style" in given:
                for name, (value, important) in declared(given["style"]).items():
                    key = (important, True, 0, (0, 0, 0), 0)
                    if name not in best or key[:2] >= best[name][0][:2]:
                        best[name] = (key, value)
            display = best.get("display", (0, "revert"))[1]
            if display == "none" or display in ("revert", "revert-layer") and "hidden" in given or best.get("content-visibility", (0, ""))[1] == "hidden":
                left.add(id(c))
                continue
            value = best.get("visibility", (0, "inherit"))[1]
            seen = visible if value in ("inherit", "unset", "revert", "revert-layer") or "var(" in value else not hides("visibility", value)
            waiting_for.append((c, State(own, parent.own | parent.above) if cascade else state, seen))
        if left or not visible:
            e.children = [c for c in e.children if (isinstance(c, kind) and id(c) not in left) or isinstance(c, str) and visible]
