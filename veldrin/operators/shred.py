"""Deeply nested records as an adjacency table, and entity tables made from it.

Every object, array and scalar of a record is a node with its parent, label, ordinal and scalar. Parts whose type
is known are shredded by expressions of the record's schema in one scan; a column that holds JSON text is parsed
in an Arrow UDF and hung in as a subtree.

Nulls: a null part, entry or field has no node, but positions count it; a map entry with a null value is a node
of kind ``null``, as is a JSON null. JSON text that isn't a valid object or array (``NaN`` and the like included) is
one ``string`` node, whatever its depth; of repeated keys the last counts. Other columns of the table, whatever their
names, play no part. An empty table gives an empty one.

Nodes are named by the names and positions from the root, joined by dots. In a node's name, a dot inside a key is
written ``~1`` and a tilde ``~0``, so that names are unique and links hold; ``children`` gives keys as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strict_json import Number, read

NODE = "struct<node:string,parent:string,path:string,label:string,ordinal:int,kind:string,parent_kind:string,key:string,scalar:string>"
_INNER = "array<struct<sub:string,up:string,label:string,ordinal:int,kind:string,parent_kind:string,key:string,scalar:string>>"
#: Characters from which a JSON node's name is a digest, so that deep texts don't make names of quadratic size.
LONG_NAME = 512


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace(".", "~1") if "." in key or "~" in key else key


def _named(up: str, key: str) -> str:
    name = f"{up}.{_escaped(key)}"
    return name if len(name) <= LONG_NAME else ".~" + hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _joined(trail: tuple | None) -> str:
    keys = []
    while trail:
        trail, key = trail
        keys.append(key)
    return ".".join(reversed(keys))


def json_nodes(text: str | None) -> list[tuple] | None:
    """Nodes of a JSON object or array, named from the root, which is the empty name; None for any other text.

    Objects that are directly elements of an array have ``key``, the names and positions from the root as they are.
    """
    if text is None or text.lstrip(" \t\r\n")[:1] not in ("{", "["):
        return None
    try:
        root = read(text)
    except ValueError:
        return None
    out: list[tuple] = []
    todo: list[tuple] = [("", None, None, None, None, None, root)]
    while todo:
        name, up, trail, ordinal, parent_kind, label, value = todo.pop()
        if isinstance(value, dict):
            kind, scalar, children = "object", None, list(value.items())
        elif isinstance(value, list):
            kind, scalar, children = "array", None, [(str(i), x) for i, x in enumerate(value)]
        else:
            kind, scalar = _scalar(value)
            children = []
        out.append((name, up, label, ordinal, kind, parent_kind, _joined(trail) if kind == "object" and parent_kind == "array" else None, scalar))
        for i in range(len(children) - 1, -1, -1):
            key, x = children[i]
            todo.append((_named(name, key), name, (trail, key), i, kind, key, x))
    return out


def _scalar(value: object) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    return ("number" if isinstance(value, Number) else "string"), str(value)


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "number" if isinstance(kind, T.NumericType) else "string"


def _node(node: Column, parent: Column, path: str, label: Column, ordinal: Column, kind: Column, parent_kind: str | None, scalar: Column, key: Column | None = None) -> Column:
    return F.struct(
        node.alias("node"), parent.alias("parent"), F.lit(path).alias("path"), label.cast("string").alias("label"), ordinal.cast("int").alias("ordinal"),
        kind.alias("kind"), F.lit(parent_kind).cast("string").alias("parent_kind"), (F.lit(None) if key is None else key).cast("string").alias("key"), scalar.cast("string").alias("scalar"),
    ).cast(NODE)


def _none() -> Column:
    return F.array().cast(f"array<{NODE}>")


def _below(path: str, only: Collection[str] | None) -> bool:
    """Whether a path leads to, or lies below, one that is asked for."""
    return only is None or any(path == o or path.startswith(f"{o}.") or o.startswith(f"{path}.") for o in only)


def _nodes(value: Column, kind: T.DataType, node: Column, parent: Column, path: str, label: Column, ordinal: Column, parent_kind: str | None, json_paths: dict[str, Column], only: Collection[str] | None) -> Column:
    """All nodes of a value, itself first; no node where it is null or isn't asked for."""
    if not _below(path, only):
        return _none()
    if path in json_paths:
        parsed = json_paths[path]
        inner = F.transform(
            parsed,
            lambda x: _node(
                F.concat(node, x["sub"]), F.when(x["up"].isNull(), parent).otherwise(F.concat(node, x["up"])),
                path, F.coalesce(x["label"], label), F.coalesce(x["ordinal"], ordinal), x["kind"], None, x["scalar"], x["key"],
            ).withField("parent_kind", F.coalesce(x["parent_kind"], F.lit(parent_kind).cast("string"))),
        )
        plain = F.array(_node(node, parent, path, label, ordinal, F.lit("string"), parent_kind, value))
        return F.when(value.isNull(), _none()).when(parsed.isNull(), plain).otherwise(inner)
    if isinstance(kind, T.StructType):
        own = [F.array(_node(node, parent, path, label, ordinal, F.lit("object"), parent_kind, F.lit(None)))]
        for i, f in enumerate(kind.fields):
            own.append(_nodes(value.getField(f.name), f.dataType, F.concat(node, F.lit(f".{_escaped(f.name)}")), node, f"{path}.{f.name}", F.lit(f.name), F.lit(i), "object", json_paths, only))
        return F.when(value.isNull(), _none()).otherwise(F.concat(*own))
    if isinstance(kind, T.ArrayType):
        own = F.array(_node(node, parent, path, label, ordinal, F.lit("array"), parent_kind, F.lit(None)))
        if not _below(f"{path}.[]", only):
            return F.when(value.isNull(), _none()).otherwise(own)
        inner = F.transform(value, lambda x, i: _nodes(x, kind.elementType, F.concat(node, F.lit("."), i.cast("string")), node, f"{path}.[]", i, i, "array", json_paths, only))
        return F.when(value.isNull(), _none()).otherwise(F.concat(own, F.flatten(inner)))
    if isinstance(kind, T.MapType):
        own = F.array(_node(node, parent, path, label, ordinal, F.lit("object"), parent_kind, F.lit(None)))
        if not _below(f"{path}.[]", only):
            return F.when(value.isNull(), _none()).otherwise(own)

        def entry(e: Column, i: Column) -> Column:
            at = F.concat(node, F.lit("."), F.replace(F.replace(e["key"].cast("string"), F.lit("~"), F.lit("~0")), F.lit("."), F.lit("~1")))
            empty = F.array(_node(at, node, f"{path}.[]", e["key"], i, F.lit("null"), "object", F.lit(None)))
            full = _nodes(e["value"], kind.valueType, at, node, f"{path}.[]", e["key"], i, "object", json_paths, only)
            return F.when(e["value"].isNull(), empty).otherwise(full)

        return F.when(value.isNull(), _none()).otherwise(F.concat(own, F.flatten(F.transform(F.map_entries(value), entry))))
    one = F.array(_node(node, parent, path, label, ordinal, F.lit(_kind(kind)), parent_kind, value))
    return F.when(value.isNull(), _none()).otherwise(one)


def shred(df: DataFrame, id_col: str, parts: Sequence[str], json_text: Collection[str] = (), only: Collection[str] | None = None) -> DataFrame:
    """``(id_col, node, parent, path, label, ordinal, kind, parent_kind, key, scalar)``: one row for each node.

    ``parts`` are columns; each is a root, a node without parent. ``json_text`` names string fields, such as
    ``question.state``, whose JSON text becomes nodes; they stand in structs only. ``path`` is the same for all
    elements of an array. ``only`` names the paths that are asked for: nothing but what leads to them and lies below
    them is read, parsed and made into nodes.
    """
    parse = F.udf(json_nodes, _INNER, useArrow=True)
    slim = df.select(F.col(f"`{id_col}`").alias("_id"), *(F.col(f"`{p}`").alias(f"_{k}") for k, p in enumerate(parts) if _below(p, only)))
    texts = {path: f"_json{k}" for k, path in enumerate(json_text) if _below(path, only)}
    for path, name in texts.items():
        part, *fields = path.split(".")
        at = F.col(f"_{list(parts).index(part)}")
        for f in fields:
            at = at.getField(f)
        slim = slim.withColumn(name, parse(at))
    parsed = {path: F.col(name) for path, name in texts.items()}
    fields = {f.name: f.dataType for f in slim.schema.fields}
    trees = [_nodes(F.col(f"_{k}"), fields[f"_{k}"], F.lit(_escaped(p)), F.lit(None).cast("string"), p, F.lit(p), F.lit(k), None, parsed, only) for k, p in enumerate(parts) if _below(p, only)]
    return slim.select("_id", F.explode(F.concat(*trees)).alias("n")).select(F.col("_id").alias(id_col), "n.*")


def _joined_objects(nodes: DataFrame, id_col: str, object_: Column, scalar: Column, kept: Sequence[str]) -> DataFrame:
    """Objects beside their scalar children: both meet by record and object in one shuffle, of nodes made once.

    ``(id_col, node, found, label, scalar)``: ``found`` holds the ``kept`` columns on the object's own row only.
    """
    at = F.when(object_, F.col("node")).otherwise(F.col("parent"))
    found = F.when(object_, F.struct(*kept))
    return nodes.where(object_ | scalar).select(id_col, at.alias("node"), found.alias("found"), F.when(scalar & ~object_, F.col("label")).alias("label"), "scalar")


def entities(nodes: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, node, parent, path, ordinal, fields)``: each object with its scalar children as a map of texts.

    Objects are joined with the scalars below them by record and parent; an object without any has an empty map.
    """
    object_ = F.col("kind") == "object"
    scalar = ~F.col("kind").isin("object", "array") & F.col("parent_kind").eqNullSafe("object")
    rows = _joined_objects(nodes, id_col, object_, scalar, ["parent", "path", "ordinal"])
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "scalar")))))
    return rows.groupBy(id_col, "node").agg(F.max("found").alias("o"), fields.alias("fields")).where("o IS NOT NULL").select(id_col, "node", "o.*", "fields")


def entity_table(nodes: DataFrame, id_col: str, path: str, columns: dict[str, str]) -> DataFrame:
    """One row for each object at ``path`` with its link to the parent and the scalar children named in ``columns``
    (name to type), pivoted from the adjacency table."""
    object_ = (F.col("path") == path) & (F.col("kind") == "object")
    scalar = F.col("path").isin([f"{path}.{c}" for c in columns])
    rows = _joined_objects(nodes, id_col, object_, scalar, ["parent", "ordinal"])
    picked = [F.max(F.when(F.col("label") == c, F.col("scalar"))).cast(kind).alias(c) for c, kind in columns.items()]
    return rows.groupBy(id_col, "node").agg(F.max("found").alias("o"), *picked).where("o IS NOT NULL").select(id_col, "node", "o.*", *columns)


def children(nodes: DataFrame, id_col: str, lists: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """``(id_col, child_path, child_key)``: elements of the ``lists`` paths by position or key, and objects that are
    elements of an array inside the JSON of the ``texts`` paths by their names and positions from its root."""
    direct = F.col("parent").isin(list(lists))
    deep = F.col("path").isin(list(texts)) & F.col("key").isNotNull()
    return nodes.where(direct | deep).select(id_col, F.when(direct, F.col("parent")).otherwise(F.col("path")).alias("child_path"), F.when(direct, F.col("label")).otherwise(F.col("key")).alias("child_key"))
