"""Web pages as trees: a row an element, with numbers that make ancestors a matter of intervals."""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag; elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
RAW_TEXT = frozenset("textarea title".split())
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
#: An element that a start tag ends without an end tag: start tag, what it ends, and elements beyond which it doesn't reach.
IMPLIED = {
    **dict.fromkeys(_BLOCKS, (frozenset(["p"]), frozenset(["button", "table", "td", "th"]))),
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:>|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

SCHEMA = (
    "page_id long, url string, pre int, last int, parent int, depth int, tag string, nth int, attrs map<string,string>, text string, own string, "
    "near_href int, near_onclick int"
)


def _tag(html: str, at: int) -> tuple[str, dict[str, str], int]:
    """The tag whose name begins there: name, attributes (the first of each name counts) and where it ends."""
    name = _NAME.match(html, at)
    at, attributes = name.end(), {}
    while at < len(html):
        found = _ATTRIBUTE.match(html, at)
        if not found:  # white space up to the page's end
            return name.group().lower(), attributes, len(html)
        at = found.end()
        if found.group(1) is None:
            break
        value = next((x for x in found.groups()[1:] if x is not None), "")
        attributes.setdefault(found.group(1).lower(), _html.unescape(value))
    return name.group().lower(), attributes, at


def elements(html: str) -> tuple[list[list], str]:
    """The elements of a page and its text (see parsed)."""
    found, texts = parsed(html)
    return found, "".join(texts)


def parsed(html: str) -> tuple[list[list], list[str]]:
    """The elements of a page, [tag, attributes, parent, depth, last, from, to, own] in the order of their start tags, and its texts
    between tags.

    last is the number of the last element within; from and to are where the element's text lies in the page's; own is the first text
    right within it. Comments, declarations, scripts and styles hold neither elements nor text; character references are resolved.
    An end tag ends the innermost open element of its name and all within; without one it means nothing. Some start tags
    end open elements (see IMPLIED); what is open at the end ends there. `<` before anything but a name is text.
    """
    out: list[list] = []
    stack: list[int] = []
    texts: list[str] = []
    size = at = 0

    def say(raw: str) -> None:
        nonlocal size
        if raw:
            text = _html.unescape(raw)
            texts.append(text)
            size += len(text)
            if stack and out[stack[-1]][7] is None:
                out[stack[-1]][7] = text

    def close(kept: int) -> None:
        for e in stack[kept:]:
            out[e][4], out[e][6] = len(out) - 1, size
        del stack[kept:]

    def innermost(names: Iterable[str], stops: Iterable[str] = ()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if out[stack[k]][0] in names:
                return k
            if out[stack[k]][0] in stops:
                break
        return -1

    waiting = 0  # where text begins that has not been said yet
    while (mark := html.find("<", at)) >= 0:
        ahead = html[mark + 1 : mark + 2]
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            say(html[waiting:mark])
            at = waiting = len(html) if end < 0 else end + 3
        elif ahead.isalpha() and ahead.isascii():
            say(html[waiting:mark])
            name, attributes, at = _tag(html, mark + 1)
            if name in IMPLIED and (k := innermost(*IMPLIED[name])) >= 0:
                close(k)
            out.append([name, attributes, stack[-1] if stack else -1, len(stack), len(out), size, size, None])
            if name not in VOID:
                stack.append(len(out) - 1)
            if name in RAW or name in RAW_TEXT:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                if name in RAW_TEXT:
                    say(html[at : end.start() if end else len(html)])
                at = end.start() if end else len(html)
            waiting = at
        elif ahead == "/" and html[mark + 2 : mark + 3].isalpha() and html[mark + 2 : mark + 3].isascii():
            say(html[waiting:mark])
            name, _, at = _tag(html, mark + 2)
            if (k := innermost((name,))) >= 0:
                close(k)
            waiting = at
        elif ahead in ("!", "?", "/"):
            say(html[waiting:mark])
            end = html.find(">", mark)
            at = waiting = len(html) if end < 0 else end + 1
        else:
            at = mark + 1
    say(html[waiting:])
    close(0)
    return out, texts


#: Which elements: all or none, those of some tags, or those for which a function of (tag, attributes, own text) holds.
Which = bool | Iterable[str] | Callable[[str, dict[str, str], str | None], bool]
#: As a tag, stands for the page itself: its number is -1, and its text that of its body, or the whole if it has none.
PAGE = "#page"


def _test(which: Which) -> Callable[[str, dict[str, str], str | None], bool]:
    if callable(which):
        return which
    if isinstance(which, bool):
        return lambda *_: which
    tags = frozenset(which)
    return lambda tag, *_: tag in tags


def page_tree(pages: DataFrame, keep: Which = True, texts: Which = False, own: bool = False, page: bool = False) -> DataFrame:
    """A row an element of each page (page_id, url, html): pre, its number; last, that of the last element within it; parent's
    pre (-1: none), depth, tag in lower case, nth (how many of its tag come before it), attrs, text, own.

    Element a is an ancestor of e if a.pre < e.pre <= a.last. keep: which elements are returned, numbered among all; page: whether
    the page itself is. texts: of which the whole text within is returned, without white space at its ends. own: whether the
    first text right within is. near_href, near_onclick: the closest element with that attribute, itself or one around it.
    A page is parsed once, in the task that reads it; a null page has no elements. Further columns are dropped.
    """
    kept, told = _test(keep), _test(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "url": pa.string(), "pre": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "tag": pa.string(),
                 "nth": pa.int32(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "own": pa.string(), "near_href": pa.int32(), "near_onclick": pa.int32()}
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found, text = elements(html or "")
                seen: dict[str, int] = {}
                near: list[tuple] = []  # of each element the closest one with an href and with an onclick, itself or around it
                for pre, (tag, attributes, parent, depth, last, start, end, first) in enumerate(found):
                    nth = seen[tag] = seen.get(tag, -1) + 1
                    around = near[parent] if parent >= 0 else (None, None)
                    near.append(tuple(pre if name in attributes else x for name, x in zip(("href", "onclick"), around, strict=True)))
                    if kept(tag, attributes, first):
                        inner = text[start:end].strip(_SPACE) if told(tag, attributes, first) else None
                        rows.append((page_id, url, pre, last, parent, depth, tag, nth, list(attributes.items()), inner, first if own else None, *near[pre]))
                if page:
                    body = next((text[e[5] : e[6]] for e in found if e[0] == "body"), text)
                    rows.append((page_id, url, -1, len(found) - 1, None, -1, PAGE, 0, [], body.strip(_SPACE), None, None, None))
                if len(rows) > 2000:
                    yield batch_of()
                    rows = []
        if rows:
            yield batch_of()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


Step = Callable[[], Column]


def step(
    tag: str | None = None, cls: str | None = None, id: str | None = None, has: str | None = None, equal: tuple[str, str] | None = None,
    part: tuple[str, str] | None = None, any_case: tuple[str, str] | None = None, nth: int | None = None,
) -> Step:
    """One step of a selector: an element's tag, one of its classes, its id, an attribute that it has; (attribute, value) that is its
    value, that its value contains, or contains in any case; how many of its tag come before. All that are given must hold."""

    def holds() -> Column:
        attribute = lambda name: F.col("attrs")[F.lit(name)]
        parts = [F.lit(True)]
        if tag:
            parts.append(F.col("tag") == tag)
        if cls:
            parts.append(F.array_contains(F.split(F.coalesce(attribute("class"), F.lit("")), r"\s+"), cls))
        if id:
            parts.append(attribute("id") == id)
        if has:
            parts.append(attribute(has).isNotNull())
        if equal:
            parts.append(attribute(equal[0]) == equal[1])
        if part:
            parts.append(attribute(part[0]).contains(part[1]))
        if any_case:
            parts.append(F.lower(attribute(any_case[0])).contains(any_case[1]))
        if nth is not None:
            parts.append(F.col("nth") == nth)
        return F.coalesce(reduce(and_, parts), F.lit(False))

    return holds


def select(tree: DataFrame, selectors: dict[str, list[Step]]) -> DataFrame:
    """The tree with a column for each selector: whether the element fits it. A selector is a list of steps, each below the one before.

    Elements' intervals nest, so an element lies within one that fits the first step if the largest `last` of those that begin
    before it reaches it: a running maximum in page order. Selectors of n steps take n - 1 such passes, all selectors' in one
    go, over one sort of each page's elements; no pair of elements is made.
    """
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    inside: dict[str, Column] = {}
    helpers = []
    for k in range(max(map(len, selectors.values())) - 1):
        new = {}
        for i, (name, steps) in enumerate(selectors.items()):
            if k < len(steps) - 1:
                fits = steps[k]() & inside[name] if name in inside else steps[k]()
                new[name] = (f"_in{i}_{k}", F.coalesce(F.max(F.when(fits, F.col("last"))).over(before) >= F.col("pre"), F.lit(False)))
        tree = tree.withColumns(dict(new.values()))
        helpers += [c for c, _ in new.values()]
        inside |= {name: F.col(c) for name, (c, _) in new.items()}
    ends = {name: steps[-1]() & inside[name] if name in inside else steps[-1]() for name, steps in selectors.items()}
    return tree.withColumns(ends).drop(*helpers)


def fitting(tree: DataFrame, selectors: dict[str, list[Step]]) -> DataFrame:
    """A row for each element and selector that it fits, with the selector's place in the list as `rank`."""
    names = list(selectors)
    flagged = select(tree, {f"_s{i}": selectors[n] for i, n in enumerate(names)})
    fits = F.array(*[F.when(F.col(f"_s{i}"), F.struct(F.lit(i).alias("rank"), F.lit(n).alias("selector"))) for i, n in enumerate(names)])
    return flagged.withColumn("_fits", F.array_compact(fits)).select(*tree.columns, F.inline("_fits"))


def near_addresses(tree: DataFrame, levels: int = 1) -> DataFrame:
    """The tree with `address` and `above`: the href of the element itself or of the closest one around it, at most `levels` further
    out, that has one; failing that the onclick found likewise; and how many levels out that is (null: neither).

    The parse tells which element that is, however deep the tree, so these are equi-joins by page and number."""
    for name in ("href", "onclick"):
        there = tree.filter(F.col("attrs")[name].isNotNull()).select(
            F.col("page_id").alias("_page"), F.col("pre").alias(f"near_{name}"), F.struct(F.col("depth"), F.col("attrs")[name].alias("value")).alias(f"_{name}")
        )
        tree = tree.join(there, (tree["page_id"] == there["_page"]) & (tree[f"near_{name}"] == there[f"near_{name}"]), "left").drop("_page").drop(there[f"near_{name}"])
    found = [
        F.when((F.col(f"_{n}.value") != "") & (F.col("depth") - F.col(f"_{n}.depth") <= levels), F.struct(F.col(f"_{n}.value").alias("address"), (F.col("depth") - F.col(f"_{n}.depth")).alias("above")))
        for n in ("href", "onclick")
    ]
    return tree.withColumn("_found", F.coalesce(*found)).select("*", "_found.address", "_found.above").drop("_found", "_href", "_onclick")


# Functions of this module go to the workers by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
