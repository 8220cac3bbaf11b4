"""Walking JSON documents held as Spark variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let


def node_at(v: Column, path: str) -> Column:
    """Sub-node as a variant; SQL NULL only when the path is absent (JSON null is a node)."""
    return F.try_variant_get(v, path, "variant")


def scalar_text(v: Column, path: str = "$") -> Column:
    """JSON text of whatever is at the path; NULL when absent or JSON null."""
    return F.try_variant_get(v, path, "string")


def string_at(v: Column, path: str) -> Column:
    """Value at the path when it is a JSON string, else NULL."""
    return F.when(F.schema_of_variant(node_at(v, path)) == "STRING", scalar_text(v, path))


PATH = "array<int>"
NODE = f"struct<node:variant,is_object:boolean,kids:array<variant>,path:{PATH}>"


def _opened(v: Column, path: Column) -> Column:
    """struct(node, is_object, kids, path) of an object or a list, NULL for scalars; each node is opened once."""
    return let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: let(
        F.coalesce(F.map_values(m), F.try_variant_get(v, "$", "array<variant>")),
        lambda kids: F.when(kids.isNotNull(), F.struct(
            v.alias("node"), m.isNotNull().alias("is_object"), kids.alias("kids"), path.alias("path")).cast(NODE))))


def json_objects(text: Column, max_depth: int | None, descend=None) -> Column:
    """struct(objects array<struct(depth, node)>, cut): every JSON object reachable in ``text``.

    Level by level inside the row: the frontier of one step is replaced by its children. Every object carries the
    positions that lead to it, and the result is in their order: depth first, an object before what is in it
    (members of an object by key).
    With ``max_depth=None`` the number of steps is the number of opening brackets, which no
    nesting can exceed, and steps with an empty frontier change nothing; the walk is complete.
    ``cut`` counts the containers left below ``max_depth``. ``descend(v)`` can stop the walk at
    an object (which is still reported). Invalid JSON yields no objects.
    """
    kind = f"struct<frontier:array<{NODE}>,objects:array<struct<depth:int,node:variant,path:{PATH}>>>"
    none = F.array().cast(f"array<struct<depth:int,node:variant,path:{PATH}>>")
    top = F.array().cast(PATH)

    def children(n: Column) -> Column:
        return F.filter(F.transform(n["kids"], lambda k, i: _opened(k, F.array_append(n["path"], i))), lambda k: k.isNotNull())

    def step(s: Column, d: Column) -> Column:
        found = F.transform(
            F.filter(s["frontier"], lambda n: n["is_object"]),
            lambda n: F.struct(d.cast("int").alias("depth"), n["node"].alias("node"), n["path"].alias("path")))
        entered = s["frontier"] if descend is None else F.filter(
            s["frontier"], lambda n: ~n["is_object"] | descend(n["node"]))
        below = F.flatten(F.transform(entered, children))
        return F.when(F.size(s["frontier"]) == 0, s).otherwise(
            F.struct(below.alias("frontier"), F.concat(s["objects"], found).alias("objects")).cast(kind))

    steps = F.lit(max_depth) if max_depth is not None else F.length(F.regexp_replace(text, r"[^\[{]+", ""))
    root = F.filter(F.array(_opened(F.try_parse_json(text), top)), lambda n: n.isNotNull())
    start = F.struct(root.alias("frontier"), none.alias("objects")).cast(kind)
    done = F.aggregate(F.sequence(F.lit(0), steps), start, step)

    def ordered(objects: Column) -> Column:
        places = F.array_sort(F.transform(objects, lambda o, i: F.struct(o["path"].alias("path"), i.alias("i"))))
        return F.transform(places, lambda p: let(F.get(objects, p["i"]), lambda o: F.struct(o["depth"].alias("depth"), o["node"].alias("node"))))

    return let(done, lambda s: F.struct(let(s["objects"], ordered).alias("objects"), F.size(s["frontier"]).alias("cut")))


def first_present(v: Column, names) -> Column:
    """Variant under the first key that exists, whatever its value."""
    return F.coalesce(*[node_at(v, path_of_key(n)) for n in names])


def first_string(v: Column, names, non_blank: bool = False) -> Column:
    """First string among the keys; with ``non_blank`` blank strings are passed over."""
    def one(n: str) -> Column:
        s = string_at(v, path_of_key(n))
        return F.when(clean_text(s) != "", s) if non_blank else s

    return F.coalesce(*[one(n) for n in names])


def first_non_blank(v: Column, names) -> Column:
    """Text of the first key whose value is present and not blank."""
    def one(n: str) -> Column:
        s = scalar_text(v, path_of_key(n))
        return F.when(clean_text(s) != "", s)

    return F.coalesce(*[one(n) for n in names])


def path_of_key(name: str) -> str:
    return f'$["{name}"]'
