"""What a page's styles show: display and visibility by the cascade, on a fixed screen.

Rules count if they apply to a screen of SCREEN: print rules and those of narrower or larger
screens don't.  Of the declarations that match an element the winner is told by importance,
style attributes, layers, specificity and order.  Selectors are compounds of tags, classes, ids
and attributes, joined as descendants or children; a rule's selectors with pseudo-classes
(but ``:root``) or sibling combinators match nothing, as they depend on what the reader does
or on places.  So does a rule under a condition that is not known: in doubt text is shown.

Selectors are matched from the root down, each element carrying on which leading parts its
ancestors have matched, so that cost grows with the page and not with its depth.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

#: The screen that pages are shown on, in CSS pixels.
SCREEN = {"width": 1280.0, "height": 720.0}
#: Features of that screen besides its size.
FEATURES = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "color": "8"}

COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?)|/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
MARK = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[{};]", re.S)
DECLARED = re.compile(r"^\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*$", re.I)
FEATURE = re.compile(r"^\(\s*(?:(min|max)-)?([a-z-]+)\s*(?::\s*([^()]+?)\s*)?\)$", re.I)
RANGE = re.compile(r"^\(\s*(?:([\d.]+[a-z]*)\s*(<=?)\s*)?(width|height)\s*(?:(<=?|>=?)\s*([\d.]+[a-z]*)\s*)?\)$", re.I)
LENGTH = re.compile(r"^([\d.]+)(px|em|rem|)$", re.I)
PART = re.compile(r"([.#])((?:[\w-]|[^\x00-\x7f])+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*)?\]|(:root)", re.I)
TAG = re.compile(r"(?:[a-z][\w-]*|\*)", re.I)
#: What matters for cutting a list of selectors: strings, brackets and commas.
CUTS = re.compile(r"\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|[\[\](),]", re.S)
#: Values of display: single ones, and those that go together.  Others are no declaration.
DISPLAYS = frozenset("none contents inline-block inline-table inline-flex inline-grid table-row-group table-header-group table-footer-group table-row table-cell table-column-group table-column table-caption ruby-base ruby-text initial inherit unset revert revert-layer -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex -ms-flexbox -ms-inline-flexbox -ms-grid".split())
TOGETHER = frozenset("block inline flow flow-root table flex grid ruby math list-item run-in".split())
#: Values of visibility that are a state; others take the parent's.
VISIBILITY = {"visible": True, "initial": True, "hidden": False, "collapse": False}


def _pixels(value: str) -> float | None:
    m = LENGTH.match(value.strip())
    try:
        return float(m[1]) * (16 if m[2].lower() in ("em", "rem") else 1) if m else None
    except ValueError:
        return None


def _condition(text: str) -> bool | None:
    """One feature in brackets on the screen; None where it is not known."""
    if m := RANGE.match(text):
        have, low, high = SCREEN[m[3].lower()], _pixels(m[1] or "0"), _pixels(m[5] or "0")
        if low is None or high is None:
            return None
        first = not m[2] or (low < have if m[2] == "<" else low <= have)
        return first and (not m[4] or {"<": have < high, "<=": have <= high, ">": have > high, ">=": have >= high}[m[4]])
    if not (m := FEATURE.match(text)):
        return None
    bound, name, value = (m[1] or "").lower(), m[2].lower(), m[3]
    if name in ("device-width", "device-height"):
        name = name[7:]
    if name in SCREEN:
        if value is None:
            return True
        size = _pixels(value)
        return None if size is None else SCREEN[name] >= size if bound == "min" else SCREEN[name] <= size if bound == "max" else SCREEN[name] == size
    if bound or name not in FEATURES:
        return None
    return FEATURES[name] == value.lower() if value is not None else True


def on_screen(media: str) -> bool:
    """Whether one of a list of media queries holds on the screen; the empty list does."""
    if not media.strip():
        return True
    for query in media.lower().split(","):
        words = re.findall(r"\([^()]*\)|[^\s()]+|[()]", query)
        negated = words[:1] == ["not"]
        words = words[1:] if words[:1] in (["not"], ["only"]) else words
        known = [w in ("all", "screen") if i == 0 and not w.startswith("(") else _condition(w) for i, w in enumerate(w for w in words if w != "and")]
        if known and None not in known and all(known) != negated:
            return True
    return False


class Rule(NamedTuple):
    selectors: str
    declared: list[tuple[str, str, bool]]  # property, value, important
    layered: bool


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """(display or visibility, value, important) of a style attribute or a rule's parts."""
    found = [(m[1].lower(), " ".join(m[2].lower().split()), bool(m[3])) for d in text.split(";") if (m := DECLARED.match(d))]
    return [(prop, value, important) for prop, value, important in found if prop != "display" or value in DISPLAYS or TOGETHER.issuperset(value.split())]


def screen_rules(css: str) -> list[Rule]:
    """Rules for the screen that set display or visibility, in their order."""
    css = COMMENT.sub(lambda m: m[1] or "", css)
    out: list[Rule] = []
    stack: list[tuple[str, str, list[str], bool]] = []  # kind, prelude, declarations, within a layer
    start = 0
    for m in MARK.finditer(css):
        c = m[0]
        if c not in "{};":
            continue
        text, start = css[start : m.start()], m.end()
        kind, layered = (stack[-1][0], stack[-1][3]) if stack else ("group", False)
        if kind == "rule" and c != "{":
            stack[-1][2].append(text)
        if c == "{":
            prelude = text.strip()
            word, _, rest = prelude[1:].partition(" ") if prelude.startswith("@") else ("", "", "")
            word, bracket, more = word.partition("(")
            word, rest = word.lower(), f"{bracket}{more} {rest}".strip()
            if kind != "group":
                stack.append(("skip", "", [], layered))
            elif not prelude.startswith("@"):
                stack.append(("rule", prelude, [], layered))
            elif word == "media" and on_screen(rest) or word == "supports" and not rest.lower().startswith("not") or word == "layer":
                stack.append(("group", "", [], layered or word == "layer"))
            else:
                stack.append(("skip", "", [], layered))
        elif c == "}" and stack:
            kind, prelude, parts, layered = stack.pop()
            if kind == "rule" and (d := declarations(";".join(parts))):
                out.append(Rule(prelude, d, layered))
    if stack and stack[-1][0] == "rule" and (d := declarations(";".join([*stack[-1][2], css[start:]]))):
        out.append(Rule(stack[-1][1], d, stack[-1][3]))
    return out


def selectors_of(text: str) -> list[str]:
    """A list of selectors cut at the commas outside brackets and strings."""
    out, start, depth = [], 0, 0
    for m in CUTS.finditer(text):
        if m[0] == "," and not depth:
            out.append(text[start : m.start()])
            start = m.end()
        depth = max(0, depth + (m[0] in "[(") - (m[0] in "])"))
    return [*out, text[start:]]


class Compound(NamedTuple):
    tag: str
    id: str
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str, str], ...]
    child: bool  # joined to the part before it as its child; else a descendant

    def matches(self, name: str, attrs: dict, classes: set[str]) -> bool:
        if self.tag and self.tag != name or self.id and attrs.get("id") != self.id or not classes.issuperset(self.classes):
            return False
        for key, op, want in self.attributes:
            have = attrs.get(key)
            if have is None or op == "=" and have != want or op == "~=" and want not in have.split() or op == "|=" and have != want and not have.startswith(want + "-"):
                return False
            if op in ("^=", "$=", "*=") and not (want and {"^": have.startswith, "$": have.endswith, "*": have.__contains__}[op[0]](want)):
                return False
        return True


def parsed(selector: str) -> list[Compound] | None:
    """Compounds from the outermost to the element itself; None for what is not matched."""
    out, at, child = [], 0, False
    selector = selector.strip()
    while at < len(selector):
        tag, ident, classes, attributes, began = "", "", [], [], at
        if m := TAG.match(selector, at):
            tag, at = m[0].lower().replace("*", ""), m.end()
        while m := PART.match(selector, at):
            at = m.end()
            if m[1] == "#":
                if ident and ident != m[2]:
                    return None
                ident = m[2]
            elif m[1]:
                classes.append(m[2])
            elif m[3]:
                attributes.append((m[3].lower(), m[4] or "", m[5] if m[5] is not None else m[6] if m[6] is not None else m[7] or ""))
            elif tag in ("", "html"):
                tag = "html"
            else:
                return None
        if at == began:
            return None
        out.append(Compound(tag, ident, tuple(classes), tuple(attributes), child))
        joint = re.compile(r"\s*>\s*|\s+|\Z").match(selector, at)
        if joint is None or ">" in joint[0] and joint.end() == len(selector):
            return None
        at, child = joint.end(), ">" in joint[0]
    return out or None


class Step(NamedTuple):
    """A leading part of selectors: all that share it take it once."""

    compound: Compound
    before: int  # number of the step before; -1 for the outermost
    ends: list[tuple[Rule, tuple, int]]  # rule, specificity and order of selectors that end here


class Cascade:
    """The rules of a page; look() is called for each element from the root down."""

    def __init__(self, styles: list[str]):
        self.steps: list[Step] = []
        self.by_key: dict[tuple[str, str], list[int]] = defaultdict(list)  # steps by id, class, tag or nothing
        numbers: dict[tuple[int, Compound], int] = {}
        for order, rule in enumerate(r for css in styles for r in screen_rules(css)):
            for text in selectors_of(rule.selectors):
                compounds, at = parsed(text) or [], -1
                for c in compounds:
                    if (at, c) not in numbers:
                        numbers[at, c] = len(self.steps)
                        self.steps.append(Step(c, at, []))
                        self.by_key[("#", c.id) if c.id else (".", c.classes[0]) if c.classes else ("", c.tag)].append(numbers[at, c])
                    at = numbers[at, c]
                if compounds:
                    weight = sum(bool(c.id) for c in compounds), sum(len(c.classes) + len(c.attributes) for c in compounds), sum(bool(c.tag) for c in compounds)
                    self.steps[at].ends.append((rule, weight, order))

    def look(self, name: str, attrs: dict, above: frozenset, parent: frozenset) -> tuple[str | None, str | None, frozenset, frozenset]:
        """(display, visibility, above and parent for the children); a property is None where
        nothing sets it.  above: steps that ancestors have matched; parent: those that the
        parent itself has."""
        found, best = set(), {}

        def declare(declared: list, *rank) -> None:
            for k, (prop, value, important) in enumerate(declared):
                inline, layered, weight, order = rank
                full = (important, inline, layered == important, weight, order, k)
                if prop not in best or full > best[prop][0]:
                    best[prop] = (full, value)

        if self.steps:
            classes = set(attrs["class"].split()) if "class" in attrs else set()
            keys = [("", ""), ("", name), *((".", c) for c in classes)]
            if "id" in attrs:
                keys.append(("#", attrs["id"]))
            for key in keys:
                for n in self.by_key.get(key, ()):
                    c, before, ends = self.steps[n]
                    if (before < 0 or before in (parent if c.child else above)) and c.matches(name, attrs, classes):
                        found.add(n)
                        for rule, weight, order in ends:
                            declare(rule.declared, False, rule.layered, weight, order)
        if "style" in attrs:
            declare(declarations(attrs["style"]), True, False, (0, 0, 0), 0)
        own = frozenset(found)
        return best.get("display", (0, None))[1], best.get("visibility", (0, None))[1], above if own <= above else above | own, own
