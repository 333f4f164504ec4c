"""Elements of a page by balanced tags: the small per-page helper behind `pages.extract_items`.

Tags are read in one pass over the page with a stack of open elements: a close tag ends
the nearest open element of its name and everything left open inside it, a close tag
without one is ignored, an open tag ends what it cannot stand in (a paragraph in a
paragraph, a row in a row), what is still open at the end ends there.  Comments and the
contents of script and style hold no elements.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# fixed values: elements without content (HTML standard)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: fixed values: elements that a following open tag ends (HTML standard), and the elements that shield them from it
_BLOCKS = ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul").split()
ENDED_BY = {"p": set(_BLOCKS), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
            "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}}
SHIELDS = {"p": {"table", "td", "th", "caption", "button"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"},
           "td": {"table"}, "th": {"table"}, "tr": {"table"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b([^>]*)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Element(NamedTuple):
    name: str
    attributes: str
    start: int      # of its content
    end: int
    parent: int     # number of the element around it, -1 at the top


class Selector(NamedTuple):
    """A tag, a class or both (`tag`, `.class`, `tag.class`); with a leading + in the next sibling of the item."""

    tag: str
    classes: frozenset[str]
    sibling: bool

    @staticmethod
    def of(text: str) -> Selector:
        tag, *classes = text.lstrip("+ ").split(".")
        return Selector(tag.lower(), frozenset(classes), text.startswith("+"))

    def fits(self, e: Element) -> bool:
        return self.tag in ("", e.name) and (not self.classes or self.classes <= set((attribute(e, "class") or "").split()))


def attribute(e: Element, name: str) -> str | None:
    return next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(e.attributes) if m[1].lower() == name), None)


def elements(html: str) -> list[Element]:
    """All elements in document order."""
    found: list[Element] = []
    stack: list[int] = []

    def close(depth: int, at: int) -> None:
        while len(stack) > depth:
            k = stack.pop()
            found[k] = found[k]._replace(end=at)

    for m in _TOKEN.finditer(html):
        if m[1]:
            found.append(Element(m[1].lower(), m[2], m.end(2) + 1, m.end(), stack[-1] if stack else -1))
        elif m[4] and not m[3]:
            name = m[4].lower()
            for old, by in ENDED_BY.items():
                if name in by:
                    for depth in range(len(stack) - 1, -1, -1):
                        open_name = found[stack[depth]].name
                        if open_name == old:
                            close(depth, m.start())
                        if open_name == old or open_name in SHIELDS[old]:
                            break
            found.append(Element(name, m[5], m.end(), m.end(), stack[-1] if stack else -1))
            if name not in VOID and not m[5].endswith("/"):
                stack.append(len(found) - 1)
        elif m[4]:
            name = m[4].lower()
            depth = next((d for d in range(len(stack) - 1, -1, -1) if found[stack[d]].name == name), None)
            if depth is not None:
                close(depth, m.start())
    close(0, len(html))
    return found


def items(html: str, container: Selector, fields: list[tuple[Selector, list[str] | None, bool]]) -> list[list[list[str]]]:
    """For each container and field the values of the matching elements inside it (or inside its next sibling):
    their content, or the first non-empty of some attributes; all of them, or (not multi) the first."""
    all_of = elements(html)
    last = [0] * len(all_of)  # number of the last element inside each element
    for k in range(len(all_of) - 1, -1, -1):
        last[k] = max(last[k], k)
        if (up := all_of[k].parent) >= 0:
            last[up] = max(last[up], last[k])
    out = []
    for k, e in enumerate(all_of):
        if not container.fits(e):
            continue
        after = last[k] + 1
        sibling = after if after < len(all_of) and all_of[after].parent == e.parent else None
        row = []
        for selector, attributes, multi in fields:
            at, values = sibling if selector.sibling else k, []
            for inner in all_of[at + 1:last[at] + 1] if at is not None else []:
                if selector.fits(inner):
                    value = html[inner.start:inner.end] if attributes is None else next((v for a in attributes if (v := attribute(inner, a))), None)
                    if value is not None or not multi:
                        values.append(value)
                        if not multi:
                            break
            row.append(values)
        out.append(row)
    return out
