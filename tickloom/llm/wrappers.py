"""Main text of pages through wrappers: union-free regular expressions inferred per host.

A page's tree is first folded on itself (runs of like elements, or of like groups of elements,
become repeated groups). Then the expressions of a host's pages are aligned one after another:
texts that differ become slots, elements that one side lacks become optional, and what repeats
on either side is repeated. The wrapper tells which region of the template is the main text (where
the pages differ most) and which texts in it are the template's own (those that a large share of
the different pages has in one place). Only where it leaves a choice do words help: an article or
main element that every page has once and that holds most of the differing text is the region, and
an element named like a comment, notice or advert is left out if it holds less than half of it.

Equal pages of a host count once. Its different pages are dealt by their hash into parts of some
256, aligned in the order of the hash, and the parts' wrappers are joined in a tree, so that a host
with a third of all pages is many tasks, and the wrapper does not depend on how Spark cuts them.
"""

from __future__ import annotations

import json
from hashlib import blake2b
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickloom.llm.common import Scratch, plain, slices
from tickloom.llm.markup import Node, blocks, tree

#: Elements that are never main text, and words of class, id and role that help to choose.
ASIDE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea input head title "
    "object embed canvas audio video dialog menu xmp noembed noframes".split()
)
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead contentinfo complementary comment comments "
    "disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended widget toolbar pagination pager search alert".split()
)
ALWAYS_ASIDE = frozenset("nav aside footer head template noscript iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGIONS = ("article", "main")
#: Elements that are a part of a text and no region, however much of the page they hold.
LINES = HEADINGS | {"p"}
#: Elements in a group that repeats, at most.
LONGEST_GROUP = 3
#: Different pages of a host before a text counts as its template's, and the share of them that has it.
SEEN, SHARE = 3, 0.5
#: Wrappers of together at most so many bytes are broadcast; beyond it, pages meet them in a join.
BROADCAST_BYTES = 8 << 20
#: Different pages of a host that are aligned in one task, about, and wrappers that are joined in one.
BATCH, FAN = 256, 32


def aside(node: Node) -> bool:
    """Whether a node's tag is none of main text. What holds the page's heading is so by few tags only."""
    if node.hidden:
        return True
    if node.holds and node.tag not in ALWAYS_ASIDE:
        return False
    return node.tag in ASIDE_TAGS


def checksum(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big")


# --- expressions: an item is a dict with k (key), o (optional), r (repeated), n (pages),
# --- and either c (items: an element or a group) or m (characters) and h (the text's checksum)


def expression(page: Node) -> list[dict]:
    """The items of a node's content, folded. Nodes beside the main text have no content."""
    items = []
    for kid in page.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            if text:
                items.append({"k": "#", "o": 0, "r": 0, "n": 1, "m": len(text), "h": checksum(text)})
        elif not aside(kid):
            items.append({"k": kid.key, "o": 0, "r": 0, "n": 1, "c": expression(kid)})
    return folded(items)


def folded(items: list[dict]) -> list[dict]:
    """Squares become repeated groups: first of one element, then of up to LONGEST_GROUP."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[dict] = []
        at = 0
        while at < len(items):
            keys = [x["k"] for x in items[at : at + size]]
            times = 1
            while [x["k"] for x in items[at + times * size : at + (times + 1) * size]] == keys and len(keys) == size:
                times += 1
            if times == 1 or keys == ["#"]:
                out.append(items[at])
                at += 1
                continue
            group = items[at : at + size]
            for i in range(1, times):
                group = [both(a, b, True) for a, b in zip(group, items[at + i * size : at + (i + 1) * size], strict=True)]
            if size == 1:
                out.append(group[0] | {"r": 1, "n": 1})
            else:
                out.append({"k": "(" + " ".join(keys) + ")", "o": 0, "r": 1, "n": 1, "c": group})
            at += times * size
        items = out
    return items


def both(a: dict, b: dict, same_page: bool = False) -> dict:
    """Two items with one key as one."""
    out = {"k": a["k"], "o": a["o"] | b["o"], "r": a["r"] | b["r"], "n": a["n"] + (0 if same_page else b["n"])}
    if "c" in a:
        return out | {"c": aligned(a["c"], b["c"])}
    return out | {"m": a["m"] + b["m"], "h": a["h"] if a["h"] == b["h"] else None}


def aligned(a: list[dict], b: list[dict]) -> list[dict]:
    """One expression for both: what only one side has is optional."""
    if len(a) == len(b) and all(x["k"] == y["k"] for x, y in zip(a, b, strict=True)):
        return [both(x, y) for x, y in zip(a, b, strict=True)]
    later: dict[str, list[int]] = {}
    for i in range(len(a) - 1, -1, -1):
        later.setdefault(a[i]["k"], []).append(i)
    out, at = [], 0
    for item in b:
        places = later.get(item["k"], [])
        while places and places[-1] < at:
            places.pop()
        if places:
            out += [x | {"o": 1} for x in a[at : places[-1]]]
            out.append(both(a[places[-1]], item))
            at = places[-1] + 1
        elif out and out[-1]["k"] == item["k"] and item["k"] != "#":
            out[-1] = both(out[-1], item) | {"r": 1}
        else:
            out.append(item | {"o": 1})
    return out + [x | {"o": 1} for x in a[at:]]


# --- from wrapper to region ---


def own(item: dict, pages: int) -> bool:
    """Whether a text is the template's, of a host with so many different pages."""
    return item["h"] is not None and item["n"] >= max(SEEN, SHARE * pages)


def mass(items: list[dict], pages: int) -> int:
    """Characters in slots, that is in texts that differ between pages."""
    total = 0
    for item in items:
        if "c" in item:
            total += mass(item["c"], pages)
        elif not own(item, pages):
            total += item["m"]
    return total


def flat(items: list[dict]) -> Iterator[dict]:
    """Items with groups opened."""
    for item in items:
        if item["k"].startswith("("):
            yield from flat(item["c"])
        else:
            yield item


def regions(wrapper: list[dict], pages: int | None = None) -> dict:
    """`paths` of the template's main regions, `fixed` texts there that are not main text, and
    `beside`: places below a region whose name says that they are not.

    The way goes down to the element that holds most of what differs between pages. A fixed text
    is known by its place (keys below the region) and checksum. `pages` is how many different
    ones the wrapper is of; if not given, as many as its commonest item has.
    """
    pages = pages or max((x["n"] for x in wrapper), default=1)
    # Too few pages to tell what differs: elements that are called a text come first.
    if pages < SEEN:
        found = _named_regions(wrapper, (), pages, 0)
        if found:
            return _described(found, pages)
    path, items, found = [], wrapper, []
    while True:
        total = mass(items, pages)
        inside = [(mass(x["c"], pages), x) for x in flat(items) if "c" in x]
        heaviest = max(inside, key=lambda p: p[0], default=(0, None))
        tag = heaviest[1]["k"].split(".")[0] if heaviest[1] else ""
        if not total or heaviest[0] < 0.8 * total or heaviest[1]["r"] or tag in LINES:
            break
        path.append(heaviest[1]["k"])
        items = heaviest[1]["c"]
    if not any(k.split(".")[0] in REGIONS for k in path):
        found = _named_regions(items, tuple(path), pages, total)
    return _described(found or [("/".join(path), items)], pages)


def _described(found: list[tuple[str, list[dict]]], pages: int) -> dict:
    return {
        "paths": sorted({p for p, _ in found}),
        "fixed": sorted(set().union(*(_fixed(i, pages) for _, i in found))),
        "beside": sorted(set().union(*(_beside(i, pages, 0.5 * mass(i, pages)) for _, i in found))),
    }


def _named_regions(items: list[dict], path: tuple[str, ...], pages: int, total: int) -> list[tuple[str, list[dict]]]:
    """Of article elements, else main ones, below a region: those that hold most of it and more than all others."""
    for tag in REGIONS:
        tagged = [
            x for x in _tagged(items, tag, path, True)
            if 0 < total < 2 * mass(x[1]["c"], pages) or not any(ASIDE_NAMES.intersection(k.split(".")[1:]) for k in x[0].split("/"))
        ]
        chosen = _chosen(tagged, pages)
        if chosen and 2 * sum(mass(x["c"], pages) for _, x, _ in chosen) > total:
            return [(p, x["c"]) for p, x, _ in chosen]
    return []


def _beside(items: list[dict], pages: int, most: float, path: str = "") -> set[str]:
    """Places of elements with a name that says so, if they hold less than `most`."""
    out = set()
    for item in flat(items):
        if "c" in item:
            here = f"{path}{item['k']}"
            if ASIDE_NAMES.intersection(item["k"].split(".")[1:]) and mass(item["c"], pages) < most:
                out.add(here)
            else:
                out |= _beside(item["c"], pages, most, f"{here}/")
    return out


def _tagged(items: list[dict], tag: str, path: tuple[str, ...], steady: bool) -> Iterator[tuple[str, dict, bool]]:
    """Path and item of the outermost elements with the tag, and whether each page has just one there."""
    for item in items:
        once = steady and not item["o"] and not item["r"]
        if item["k"].startswith("("):
            yield from _tagged(item["c"], tag, path, once)
        elif "c" in item:
            here = (*path, item["k"])
            if item["k"].split(".")[0] == tag:
                yield "/".join(here), item, once
            else:
                yield from _tagged(item["c"], tag, here, once)


def _chosen(found: list[tuple[str, dict, bool]], pages: int) -> list[tuple[str, dict, bool]]:
    """The regions that every page has once, if they hold most of what differs between pages, else all.

    (Others beside them are what readers add, or lists of other pages.)
    """
    steady = [x for x in found if x[2]]
    if pages < SEEN or 2 * sum(mass(x["c"], pages) for _, x, _ in steady) <= sum(mass(x["c"], pages) for _, x, _ in found):
        return found
    return steady


def _fixed(items: list[dict], pages: int, path: str = "") -> set[str]:
    out = set()
    for item in flat(items):
        if "c" in item:
            out |= _fixed(item["c"], pages, f"{path}{item['k']}/")
        elif own(item, pages):
            out.add(f"{path}{item['h']}")
    return out


# --- pages ---


def main_text(page: str, wrapper: dict | None) -> str:
    """The main text by the wrapper's regions; a page without any of them is its own template."""
    root = tree(page)
    found = _at(root, wrapper["paths"]) if wrapper else []
    if not found:
        wrapper = regions(expression(root))
        found = _at(root, wrapper["paths"])
    fixed, beside = set(wrapper["fixed"]), set(wrapper["beside"])
    parts: list = []
    for node in found:
        kids = node.kids
        if fixed or beside:
            kids = [_without(k, fixed, beside) for k in kids]
        parts += [None, *kids]
    return " ".join(blocks(_headed(parts), aside))


def _headed(parts: list) -> list:
    """Of a header inside a region only its headings are main text."""
    out = []
    for part in parts:
        if isinstance(part, Node):
            if part.tag == "header":
                part = Node("div", holds=True, kids=list(_headings(part)))
            elif part.kids:
                part = Node(part.tag, part.names, part.hidden, part.holds, _headed(part.kids))
        out.append(part)
    return out


def _headings(node: Node) -> Iterator[Node]:
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.tag in HEADINGS:
                yield kid
            else:
                yield from _headings(kid)


def _without(part, fixed: set[str], beside: set[str], path: str = ""):
    if isinstance(part, str):
        text = " ".join(part.split())
        return "" if text and f"{path}{checksum(text)}" in fixed else part
    here = f"{path}{part.key}"
    if here in beside:
        return Node(part.tag)
    kids = [_without(k, fixed, beside, f"{here}/") for k in part.kids]
    return Node(part.tag, part.names, part.hidden, part.holds, kids)


def _at(root: Node, paths: list[str]) -> list[Node]:
    """The nodes at these paths, in page order."""
    out: list[Node] = []
    wanted = set(paths)
    heads = {p[: i] for p in paths for i in range(len(p)) if p[i] == "/"} | wanted
    todo: list[tuple[Node, str]] = [(root, "")]
    if "" in wanted:
        return [root]
    while todo:
        node, path = todo.pop()
        if path in wanted:
            out.append(node)
            continue
        nodes = [k for k in node.kids if isinstance(k, Node) and not aside(k)]
        todo += [(k, p) for k in reversed(nodes) if (p := f"{path}/{k.key}" if path else k.key) in heads]
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


# --- Spark ---

PAGE = "host string, page binary, wrapper string"
PARTIAL = "host string, part long, pages long, wrapper string"


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The expression of every page, once of equal ones of a batch, with a hash that tells pages apart."""
    for batch in slices(batches, "html"):
        found: dict[tuple[str, bytes], str] = {}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if page:
                key = host_of(url), blake2b(page.encode(), digest_size=16).digest()
                if key not in found:
                    found[key] = json.dumps(expression(tree(page)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.binary()), pa.array(found.values(), pa.string())],
            ["host", "page", "wrapper"],
        )


def _joined(order: str):
    def run(table: pa.Table) -> pa.Table:
        """The wrappers of one host and part as one, aligned in a fixed order."""
        wrapper = None
        for text in table.sort_by(order)["wrapper"].to_pylist():
            wrapper = json.loads(text) if wrapper is None else aligned(wrapper, json.loads(text))
        return pa.table({
            "host": pa.array([table["host"][0].as_py()], pa.string()), "part": pa.array([table["part"][0].as_py()], pa.int64()),
            "pages": pa.array([table["pages"][0].as_py()], pa.int64()), "wrapper": pa.array([json.dumps(wrapper)], pa.string()),
        })

    return run


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, pages (different ones) and wrapper (JSON) of every host of `pages` (url, html)."""
    every = plain(pages, url="string", html="string").mapInArrow(_expressions, PAGE)
    different = scratch.stored("expressions", every.dropDuplicates(["host", "page"]))
    counts = different.groupBy("host").agg(F.count("*").alias("pages"))
    most = counts.agg(F.max("pages").alias("pages"), F.sum(F.octet_length("host") + 16).alias("size")).first()
    width = -(-(most.pages or 1) // BATCH)
    part = F.pmod(F.xxhash64("page"), F.ceil(F.col("pages") / BATCH))
    side = F.broadcast(counts) if (most["size"] or 0) <= BROADCAST_BYTES else counts
    # Dealt anew by both columns: else the parts of a host would stay where its pages met their count.
    dealt = different.join(side, "host").withColumn("part", part).repartition("host", "part")
    found = dealt.groupBy("host", "part").applyInArrow(_joined("page"), PARTIAL)
    while width > 1:
        above = found.withColumn("part", F.floor(F.col("part") / FAN)).repartition("host", "part")
        found = above.groupBy("host", "part").applyInArrow(_joined("wrapper"), PARTIAL)
        width = -(-width // FAN)
    return found.select("host", "pages", "wrapper")


def _regions_of(wrapper: pa.Array, pages: pa.Array) -> pa.Array:
    rows = zip(wrapper.to_pylist(), pages.to_pylist(), strict=True)
    return pa.array([json.dumps(regions(json.loads(w), n)) for w, n in rows], pa.string())


def _hosts(urls: pa.Array) -> pa.Array:
    return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())


def _texts(pages: pa.Array, found: pa.Array) -> pa.Array:
    known: dict[str, dict] = {}
    out = []
    for page, text in zip(pages.to_pylist(), found.to_pylist(), strict=True):
        if text is not None and text not in known:
            known[text] = json.loads(text)
        out.append(main_text(page, known.get(text)) if page else "")
    return pa.array(out, pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A null or empty page has an empty text; a null url is a host of its own. Repeated rows and
    ids give rows of their own. Very long and broken pages are read in one pass. An empty table
    gives an empty result. Other columns go, whatever their names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "wrappers")
    rule = F.arrow_udf(_regions_of, StringType())
    found = scratch.stored("regions", wrappers(pages, scratch).select("host", rule("wrapper", "pages").alias("regions")))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("regions"))).first()[0] or 0
    rows = plain(pages, page_id="long", url="string", html="string").withColumn(
        "host", F.arrow_udf(_hosts, StringType())("url")
    )
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    return (
        rows.join(side, "host", "left")
        .select("page_id", "url", F.arrow_udf(_texts, StringType())("html", "regions").alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
