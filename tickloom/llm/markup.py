"""Trees of pages: a forgiving reader of HTML, and the text of a tree block by block."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: A tag ends at its `>`. One that meets a `<` outside quotes before it, or the end of the page, is
#: broken and dropped as far as it was read, so no part of a page is read twice. Runs of broken tags
#: without quotes are one token. A quote that is never closed is a character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|(?:</?[a-zA-Z][^<>\"']*+(?=<))++"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z|(?=<))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td template tfoot th thead title tr ul br".split()
)
ENDS_P = BLOCK - frozenset("body head html br caption tbody td tfoot th thead tr option optgroup title legend".split())
#: An opening tag ends these, if one is open nearer than the tags after them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


HEAD = frozenset(("h1", "main"))
#: Elements nested deeper hang beside their parent, so that no page makes a tree too deep to walk;
#: so many may be open, further ones hold nothing of their own.
DEEPEST, OPEN = 120, 512


@dataclass
class Node:
    tag: str
    names: frozenset[str] = frozenset()
    hidden: bool = False
    holds: bool = False  # the page's heading or its main element
    kids: list = field(default_factory=list)  # nodes and texts

    @property
    def key(self) -> str:
        return ".".join([self.tag, *sorted(self.names)])


def _named(tag: str, attributes: str) -> Node:
    node = Node(tag)
    if attributes and attributes != "/":
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        words = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        node.names = frozenset(w for w in re.split(r"[^a-z]+", words) if w)
        style = re.sub(r"\s", "", found.get("style", "").lower())
        node.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    return node


def tree(page: str) -> Node:
    """The page as a tree. Tags that are never closed end with what holds them."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    open_tags: Counter[str] = Counter()
    while at < n:
        found = TOKEN.search(page, at)
        start = found.start() if found else n
        if start > at:
            stack[-1].kids.append(page[at:start])
        if not found:
            break
        at = found.end()
        if found[4] != ">":
            continue
        tag = found[2].lower()
        if found[1]:
            if open_tags[tag]:
                _close(stack, tag, open_tags)
            continue
        if tag in ENDS_P and open_tags["p"]:
            _end(stack, {"p"}, BLOCK - {"p"}, open_tags)
        if tag in ENDS:
            _end(stack, *ENDS[tag], open_tags)
        node = _named(tag, found[3])
        node.hidden |= len(stack) > DEEPEST and stack[-1].hidden
        stack[min(len(stack), DEEPEST) - 1].kids.append(node)
        if tag in HEAD:
            node.holds = True
            for outer in reversed(stack):
                if outer.holds:
                    break
                outer.holds = True
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            after = page.find(">", end.end()) if end else -1
            at = after + 1 if after >= 0 else n
        elif tag not in VOID and len(stack) < OPEN:
            stack.append(node)
            open_tags[tag] += 1
    return root


def _cut(stack: list[Node], at: int, open_tags: Counter[str]) -> None:
    open_tags.subtract(node.tag for node in stack[at:])
    del stack[at:]


def _end(stack: list[Node], tags: set[str], walls: set[str], open_tags: Counter[str]) -> None:
    """Closes the outermost open one of `tags` above the last of `walls`."""
    last = None
    if not any(open_tags[t] for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            last = i
        elif stack[i].tag in walls:
            break
    if last is not None:
        _cut(stack, last, open_tags)


def _close(stack: list[Node], tag: str, open_tags: Counter[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            _cut(stack, i, open_tags)
            return
        if tag not in BLOCK and stack[i].tag in BLOCK:
            return


def blocks(parts: list, skip) -> list[str]:
    """The texts of nodes and raw texts, block by block, white space settled; `skip` leaves nodes out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo = list(reversed(parts))
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif not skip(part):
            if part.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(part.kids))
    flush()
    return out
