"""HTML documents as tables of tokens and elements.

A page is one row, and so is everything built here: its tokens, its elements with their extents, and whatever is
selected from them. No page crosses the network, and two rows never mix, whether or not they share a url.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import DECODE, built_once, let_sql

# elements that end where the next one of the same kind starts
IMPLIED_END = ("p", "li", "dt", "dd", "option", "tr", "td", "th")

def tokenized(pages: DataFrame, raw_blocks: bool = True) -> DataFrame:
    """(site, url, toks): one row per page with its token array.

    The one-element explode keeps the array from being computed again for every use of it.
    """
    return pages.select("site", "url", F.explode(F.array(H.html_token_array(F.col("html"), raw_blocks))).alias("toks"))


def html_tokens(pages: DataFrame) -> DataFrame:
    """(url, pos, kind, tag, tok) in page order."""
    exploded = pages.select("url", F.posexplode(H.html_token_array(F.col("html"))).alias("pos", "tok"))
    return exploded.select(
        "url", "pos", H.token_kind(F.col("tok")).alias("kind"), H.token_tag(F.col("tok")).alias("tag"), "tok")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``value`` under a name, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _cut(array: str, start: str, end: str) -> str:
    """SQL: the items from ``start`` to ``end``, as far as there are; a slice would convert the whole array each time."""
    return f"transform(IF({start} <= least({end}, size({array}) - 1), sequence({start}, least({end}, size({array}) - 1)), array()), j -> get({array}, j))"


def _scanned(items: str, zero: str, step: str, out: str) -> str:
    """SQL: an array with ``out`` for every item ``x``, given the state ``st`` that a fold has reached with it.

    ``step`` sees the item as ``x`` and the state before it as ``st``. A fold copies its accumulator at every step,
    so one that gathers a result per item costs the square of their number. Here a first fold keeps only the states between
    stretches of items, and each stretch is folded again from there; stretches as long as the cube root balance the two.
    """
    parts = f"transform(sequence(0, CAST((size(v) - 1) div w AS int)), k -> {_cut('v', 'k * w', 'k * w + w - 1')})"
    starts = f"aggregate(parts, array({zero}), (a, part) -> array_append(a, aggregate(part, element_at(a, -1), (st, x) -> {step})))"
    states = f"aggregate(part, array(starts[k]), (q, x) -> array_append(q, {_let('element_at(q, -1)', 'st', step)}))"
    outs = f"transform(parts, (part, k) -> {_let(states, 'q', f'transform(part, (x, i) -> {_let("q[i + 1]", "st", out)})')})"
    found = f"flatten({_let(_let('CAST(cbrt(size(v)) AS int) + 1', 'w', parts), 'parts', _let(starts, 'starts', outs))})"
    return _let(items, "v", f"IF(size(v) = 0, array(), {found})")


_VOID = ", ".join(f"'{v}'" for v in H.VOID_TAGS)
_IMPLIED = ", ".join(f"'{t}'" for t in IMPLIED_END)


def _tag_events(toks: str, raw_open: str) -> str:
    """Tag tokens of a page, open ones first: array<struct(tag, p, close, c)>; ``c`` counts the open tags up to here.

    The count of an open tag is its place among these, that of a close tag its place among all less its place among these.
    """
    tags = f"""filter(transform({toks}, (t, i) -> IF(t rlike '^</?[a-zA-Z]' AND NOT t rlike r'{raw_open}',
      named_struct('tag', lower(regexp_extract(t, r'{H.TAG_NAME}', 1)), 'p', i, 'close', startswith(t, '</')), NULL)), x -> x IS NOT NULL)"""
    shut = "filter(transform(g, (x, i) -> IF(x.close, named_struct('x', x, 'i', i), NULL)), y -> y IS NOT NULL)"
    event = "named_struct('tag', {0}.tag, 'p', {0}.p, 'close', {0}.close, 'c', {1})"
    return _let(tags, "g", f"""concat(transform(filter(g, x -> NOT x.close), (x, k) -> {event.format("x", "k + 1")}),
      transform({shut}, (y, j) -> {event.format("y.x", "y.i - j")}))""")


def _levels(events: str) -> str:
    """Events by (tag, level, position): array<struct(tag, level, p, close, c, next)>.

    The level of a tag token is the number of open elements of its own kind, its own included. On one level, open and close
    tokens take turns, so an element's close is simply its neighbour. Close tokens with nothing to close are left out.
    """
    by_tag = f"sort_array(filter({events}, x -> NOT (x.close AND x.tag IN ({_VOID}))))"
    # an item is 2 for the first token of its tag, and 1 more for a close token; a state is the level reached by an open token, or
    # less than 1, by a close token, which leaves one element less open
    items = "transform(g, (x, i) -> IF(get(g, i - 1).tag = x.tag, 0, 2) + IF(x.close, 1, 0))"
    before = "IF(x > 1, 0, IF(st > 0, st, greatest(-st - 1, 0)))"
    levels = _scanned(items, "0", f"IF(x IN (1, 3), -{before}, {before} + 1)", "abs(st)")
    following = f"IF(x.tag IN ({_IMPLIED}) AND get(g, i + 1).tag = x.tag, named_struct('p', get(g, i + 1).p, 'c', get(g, i + 1).c), NULL)"
    return _let(by_tag, "g", _let(levels, "n", f"""sort_array(filter(transform(g, (x, i) -> IF(n[i] > 0,
      named_struct('tag', x.tag, 'level', n[i], 'p', x.p, 'close', x.close, 'c', x.c, 'next', {following}), NULL)), x -> x IS NOT NULL))"""))


def _nodes(events: str) -> str:
    """Elements in page order: array<struct(s, e, c, i, tag, void, next)>, closed ones with their end and the open tags up to it."""
    shut = "get(l, i + 1).close AND get(l, i + 1).tag = x.tag AND get(l, i + 1).level = x.level"
    end = "IF(x.tag IN ({0}), x.{1}, IF({2}, get(l, i + 1).{1}, NULL))"
    node = f"""named_struct('s', x.p, 'e', {end.format(_VOID, "p", shut)}, 'c', {end.format(_VOID, "c", shut)}, 'i', x.c,
      'tag', x.tag, 'void', x.tag IN ({_VOID}), 'next', x.next)"""
    return _let(_levels(events), "l", f"sort_array(filter(transform(l, (x, i) -> IF(x.close, NULL, {node})), q -> q IS NOT NULL))")


def _ended(nodes: str, past: str, opened: str) -> str:
    """The end of every element, and the open tags up to there: array<struct(e, c)>.

    An element that is never closed ends before the next element of the same kind where HTML implies that (p, li, ...),
    otherwise where its closest closed ancestor ends, else with the page. Only closed elements count as ancestors.
    """
    # the state holds the ends of the closed elements around a place, the element there included
    step = _let("filter(st, o -> o.e >= x.s)", "still", "IF(x.e > x.s, array_append(still, named_struct('e', x.e, 'c', x.c)), still)")
    end = f"""IF(x.e IS NOT NULL, named_struct('e', x.e, 'c', x.c), {_let('array_min(st)', 'around',
      f"named_struct('e', least(x.next.p - 1, around.e - 1, {past}), 'c', least(x.next.c - 1, around.c, {opened}))")})"""
    swept = _scanned(nodes, "CAST(array() AS array<struct<e:int,c:int>>)", step, end)
    return f"IF(exists({nodes}, x -> x.e IS NULL), {swept}, transform({nodes}, x -> named_struct('e', x.e, 'c', x.c)))"


def _step(rows: DataFrame, name: str, array: Column) -> DataFrame:
    """Add an array column; the one-element explode keeps it from being computed again for every use of it."""
    return rows.select("*", F.explode(F.array(array)).alias(name))


@built_once
def _usual_events() -> Column:
    return F.expr(_tag_events("toks", H.RAW_OPEN))


@built_once
def _all_events() -> Column:
    return F.expr(_tag_events("toks", H.SCRIPT_OPEN))


@built_once
def _node_array() -> Column:
    return F.expr(_nodes("events"))


@built_once
def _elements() -> Column:
    last = "coalesce(array_max(transform(events, x -> x.p)), -1) + 1"
    opened = "coalesce(array_max(transform(events, x -> x.c)), 0)"
    ended = _let(last, "past", _let(opened, "opened", _ended("nodes", "past", "opened")))
    shaped = """transform(nodes, (x, k) -> named_struct('s', x.s, 'e', f[k].e, 'i', x.i, 'n', f[k].c - x.i, 'tag', x.tag, 'void', x.void,
      'closed', x.e IS NOT NULL AND NOT x.void, 'tok', toks[x.s]))"""
    return F.transform(F.expr(_let(ended, "f", shaped)), lambda e: F.struct(
        *[e[c].alias(c) for c in ("s", "e", "i", "n", "tag", "void", "closed", "tok")], H.class_list(e["tok"]).alias("classes")))


def with_elements(pages: DataFrame, wanted: Column) -> DataFrame:
    """Add ``toks`` and ``els`` (see ``page_dom``), empty where a page is not ``wanted``."""
    tokens = F.when(wanted, H.html_token_array(F.col("html"))).otherwise(F.array().cast("array<string>"))
    events = _step(_step(pages, "toks", tokens), "events", _usual_events())
    return _step(_step(events, "nodes", _node_array()), "els", _elements()).drop("events", "nodes")


def page_dom(pages: DataFrame, raw_blocks: bool = True) -> DataFrame:
    """(site, url, toks, els): one row per page with its tokens and its elements in page order.

    ``els`` is array<struct(s, e, i, n, tag, void, closed, tok, classes)>: first and last token, number in the page
    (from 1), number of elements inside. The elements inside the i-th one are the n that follow it.
    """
    events = _step(tokenized(pages, raw_blocks), "events", _usual_events() if raw_blocks else _all_events())
    return _step(_step(events, "nodes", _node_array()), "els", _elements()).select("site", "url", "toks", "els")


def html_elements(pages: DataFrame) -> DataFrame:
    """(url, start_pos, end_pos, tag, void, closed, tok) for every element."""
    return page_dom(pages).select("url", F.explode("els").alias("e")).select(
        "url", F.col("e.s").alias("start_pos"), F.col("e.e").alias("end_pos"), "e.tag", "e.void", "e.closed", "e.tok")


# --- predicates over one element struct ----------------------------------------------------

def has_class(e: Column, *names: str) -> Column:
    return reduce(Column.__or__, [F.array_contains(e["classes"], n) for n in names])


def class_like(e: Column, regex: str) -> Column:
    """A single class name, or the whole class attribute, contains a match."""
    return F.when(F.size(e["classes"]) == 1, e["classes"][0].rlike(regex)).otherwise(
        F.exists(e["classes"], lambda x: x.rlike(regex)) | F.array_join(e["classes"], " ").rlike(regex))


def class_contains(e: Column, part: str) -> Column:
    """[class*='part']"""
    return F.contains(F.array_join(e["classes"], " "), F.lit(part))


def has_attr(e: Column, name: str, value: str | None = None, contains: str | None = None) -> Column:
    a = H.attr(e["tok"], name)
    if value is not None:
        return F.coalesce(a == value, F.lit(False))
    if contains is not None:
        return F.coalesce(F.contains(a, F.lit(contains)), F.lit(False))
    return a.isNotNull()


# --- selection inside a row ----------------------------------------------------------------

Predicate = Callable[[Column], Column]


def matching(els: Column, predicate: Predicate) -> Column:
    return F.filter(els, lambda e: predicate(e))


def first_match(els: Column, predicate: Predicate) -> Column:
    """First element in page order that matches, NULL when none does."""
    return F.try_element_at(F.filter(els, lambda e: predicate(e)), F.lit(1))


def inside(els: Column, outer: Column) -> Column:
    """Descendants of an element: the slice that follows it in the elements of the page, or of another element around it."""
    start = outer["i"] - F.get(els, F.lit(0))["i"] + 1
    end = F.least(start + outer["n"], F.size(els)) - 1
    return F.transform(F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>")), lambda k: F.get(els, k))


def inside_any(els: Column, outers: Column) -> Column:
    """Elements of the page that lie inside at least one of the given ones, in page order."""
    numbers = F.flatten(F.transform(F.filter(outers, lambda o: o["n"] > 0), lambda o: F.sequence(o["i"] + 1, o["i"] + o["n"])))
    return F.transform(F.sort_array(F.array_distinct(numbers)), lambda i: F.element_at(els, i))


def node_text(toks: Column, node: Column, separator: str = "") -> Column:
    """Text of an element; NULL when the element is NULL."""
    text = f"array_join(filter({_cut('x.toks', 'x.n.s', 'x.n.e')}, t -> NOT t rlike '^<[a-zA-Z/!?]'), '{separator}')"
    return let_sql(F.struct(toks.alias("toks"), node.alias("n")),
                   f"x -> CASE WHEN x.n IS NOT NULL THEN element_at(transform(array({text}), {DECODE}), 1) END")


def explode_nodes(dom: DataFrame, nodes: Column, separator: str | None = None) -> DataFrame:
    """(site, url, start_pos, end_pos, tag, tok, classes[, text]): one row per selected element."""
    shaped = nodes if separator is None else F.transform(nodes, lambda e: F.struct(
        e["s"].alias("s"), e["e"].alias("e"), e["tag"].alias("tag"), e["tok"].alias("tok"),
        e["classes"].alias("classes"), node_text(F.col("toks"), e, separator).alias("text")))
    out = dom.select("site", "url", F.explode(shaped).alias("n"))
    return out.select(
        "site", "url", F.col("n.s").alias("start_pos"), F.col("n.e").alias("end_pos"), "n.tag", "n.tok", "n.classes",
        *([] if separator is None else ["n.text"]))


def select_elements(pages: DataFrame, predicate: Predicate, within: Predicate | None = None) -> DataFrame:
    """Elements of the pages that match, optionally only inside elements matching ``within``."""
    dom = page_dom(pages)
    els = F.col("els")
    return explode_nodes(dom, matching(els if within is None else inside_any(els, matching(els, within)), predicate))


def subtree_text(pages: DataFrame, predicate: Predicate, separator: str = "") -> DataFrame:
    """Matching elements with the text of their subtrees."""
    return explode_nodes(page_dom(pages), matching(F.col("els"), predicate), separator)


def _outside(cuts: str) -> str:
    """SQL: tokens of ``toks`` outside the cuts, as array<struct(pos, tok)>.

    ``cuts`` is array<struct(s, e)> in page order, ``e`` being the last place that this cut or one before it reaches. What lies
    between two cuts is a slice.
    """
    start, end = "IF(k = 0, 0, least(d[k - 1].e, size(t) - 1) + 1)", "IF(k = size(d), size(t), d[k].s)"
    gap = _let(start, "a", f"slice(t, a + 1, greatest({end} - a, 0))")
    gaps = f"IF(size(t) = 0, t, flatten(transform(sequence(0, size(d)), k -> {gap})))"
    return _let(cuts, "d", _let("transform(toks, (x, i) -> named_struct('pos', i, 'tok', x))", "t", gaps))


def _tag_cuts(tags: Sequence[str]) -> str:
    """SQL: extents of the outermost subtrees of some tags: array<struct(s, e)>."""
    marks = f"""filter(transform(toks, (t, i) -> IF(t rlike r'(?i)^</?(?:{"|".join(tags)})(?:[\\s/>])', named_struct('p', i, 'close', startswith(t, '</')), NULL)),
      x -> x IS NOT NULL)"""
    # the state is (subtrees open before, after)
    step = "named_struct('before', st.after, 'after', greatest(0, st.after + IF(x.close, -1, 1)))"
    outer = _scanned(marks, "named_struct('before', 0, 'after', 0)", step, "IF(st.before = 0 OR st.after = 0, named_struct('p', x.p, 'alone', st.before = st.after, 'close', x.close), NULL)")
    return _let(f"filter({outer}, x -> x IS NOT NULL)", "m", """filter(transform(m, (x, i) -> IF(x.alone, named_struct('s', x.p, 'e', x.p),
      IF(x.close, NULL, named_struct('s', x.p, 'e', coalesce(get(m, i + 1).p, size(toks)))))), x -> x IS NOT NULL)""")


def is_furniture(e: Column, tags: Sequence[str] = H.FURNITURE) -> Column:
    """Elements around the content: by tag, by a part of the class attribute or by a part of the id."""
    ids = H.attr(e["tok"], "id")
    named = [F.contains(ids, F.lit(p)) for p in H.FURNITURE_ID_PARTS]
    return reduce(Column.__or__, [e["tag"].isin(*tags), *[class_contains(e, p) for p in H.FURNITURE_CLASS_PARTS],
                                  *[F.coalesce(n, F.lit(False)) for n in named]])


@built_once
def _furniture_outside() -> Column:
    reach = _scanned("furniture", "-1", "greatest(st, x.e)", "named_struct('s', x.s, 'e', st)")
    return F.expr(_outside(reach))


def _without_furniture(pages: DataFrame) -> DataFrame:
    """(site, url, kept): tokens outside all furniture elements, whatever is nested in them."""
    dom = page_dom(pages)
    return _step(_step(dom, "furniture", F.filter("els", lambda e: is_furniture(e))), "kept", _furniture_outside()).select("site", "url", "kept")


def stripped_html(pages: DataFrame) -> DataFrame:
    """(site, url, main_html): the pages without their furniture elements."""
    return _without_furniture(pages).select("site", "url", F.array_join(F.transform("kept", lambda k: k["tok"]), "").alias("main_html"))


def drop_subtrees(pages: DataFrame, tags: Sequence[str] = H.FURNITURE, strip_classes: bool = False) -> DataFrame:
    """(url, pos, kind, tag, tok): tokens outside the subtrees of the given tags.

    A stray close tag of such a kind is left out, but hides nothing that follows; an open one that is never closed hides the
    rest. With ``strip_classes``, elements whose class or id names them as furniture go too (see ``is_furniture``), and
    extents are those of ``page_dom``.
    """
    if strip_classes:
        kept = _without_furniture(pages)
    else:
        kept = _step(tokenized(pages), "kept", F.expr(_outside(_tag_cuts(tags))))
    kept = kept.select("url", F.explode("kept").alias("x"))
    tok = F.col("x.tok")
    return kept.select("url", "x.pos", H.token_kind(tok).alias("kind"), H.token_tag(tok).alias("tag"), tok.alias("tok"))


def innermost(dom: DataFrame, places: Column) -> DataFrame:
    """Add ``inner``, array<struct(pos, i)>: for every place (a token number) the number of the innermost element around it.

    Elements and places are merged in page order, and one fold keeps the elements that are still open.
    """
    marks = """sort_array(concat(transform(filter(els, x -> NOT x.void), x -> named_struct('p', x.s, 'i', x.i, 'e', x.e)),
      transform(places, p -> named_struct('p', p, 'i', 0, 'e', 0))))"""
    step = _let("filter(st, o -> o.e >= x.p)", "still", "IF(x.i > 0, array_append(still, named_struct('i', x.i, 'e', x.e)), still)")
    found = _scanned(marks, "CAST(array() AS array<struct<i:int,e:int>>)", step, "IF(x.i = 0, named_struct('pos', x.p, 'i', get(st, size(st) - 1).i), NULL)")
    return _step(_step(dom, "places", places), "inner", F.expr(f"filter({found}, x -> x IS NOT NULL)"))
