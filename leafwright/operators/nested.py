"""Deeply nested records to related flat tables, by Dewey labels.

Every node gets the path of ordinals that leads to it (its Dewey label); the label of its parent is
that path without the last ordinal. Nodes are grouped by schema path into tables. Labels need no
coordination between tasks, so one narrow pass over the records suffices and no shuffle happens.

Defined cases: a null or empty array has no children; a null array element keeps its ordinal and its
row (``is_null`` true) so that nothing is lost, but it counts as no child; a record with a null key
keeps its rows under a null key; repeated records give repeated rows unless ``latest_records`` ran
first; an empty table gives empty tables; further scalar columns stay in the root table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_children(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def latest_records(df: DataFrame, key: str, loaded: str = "loaded_at") -> DataFrame:
    """One row per key: the last delivered; rows with a null key stay, but exact repeats of them go."""
    rest = [c for c in df.columns if c not in (key, loaded)]
    payload = F.struct(*[F.col(c) for c in rest])
    with_key = df.where(F.col(key).isNotNull())
    best = with_key.groupBy(key).agg(F.max_by(payload, F.struct(F.col(loaded), F.xxhash64(*[c for c in rest if not _has_map(df.schema[c].dataType)]))).alias("_row"))
    kept = best.select(F.col(key), *[F.col(f"_row.{c}").alias(c) for c in rest])
    no_key = df.where(F.col(key).isNull()).drop(loaded)
    no_key = no_key.select(key, *rest).dropDuplicates() if not _has_map(no_key.schema) else no_key.select(key, *rest)
    return kept.unionByName(no_key)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def shred(df: DataFrame, key: str, children: str) -> dict[str, DataFrame]:
    """Tables by schema path: ``""`` for the records, then one per array of structs and per nested struct.

    Each child table holds ``key``, ``dewey`` (array of ordinals), ``parent`` (the truncated label),
    ``ord`` (the last ordinal), ``is_null`` and the scalar fields of its element. A nested struct gets
    a table under the label of its owner (``parent`` and ``dewey`` are then equal).
    """
    scalars = [f.name for f in df.schema.fields if f.name != children and not _is_children(f.dataType)]
    tables = {"": df.select(*scalars)}
    base = df.select(F.col(key), F.array().cast("array<int>").alias("dewey"), F.col(children).alias("_kids"))
    _descend(base, key, df.schema[children].dataType.elementType, children, tables)
    return tables


def _descend(base: DataFrame, key: str, kind: T.StructType, path: str, tables: dict[str, DataFrame]) -> None:
    nodes = base.select(key, F.col("dewey").alias("parent"), F.posexplode("_kids").alias("ord", "_node")).select(
        key, "parent", "ord", F.concat("parent", F.array("ord")).alias("dewey"), "_node"
    )
    plain = [f for f in kind.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType))]
    tables[path] = nodes.select(key, "dewey", "parent", "ord", F.col("_node").isNull().alias("is_null"), *[F.col(f"_node.{f.name}").alias(_clear(f.name, key)) for f in plain])
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            owned = nodes.where(F.col(f"_node.{f.name}").isNotNull())
            tables[f"{path}.{f.name}"] = owned.select(key, "dewey", F.col("dewey").alias("parent"), *[F.col(f"_node.{f.name}.{g.name}").alias(_clear(g.name, key)) for g in f.dataType.fields])
        elif _is_children(f.dataType):
            _descend(nodes.select(key, "dewey", F.col(f"_node.{f.name}").alias("_kids")), key, f.dataType.elementType, f"{path}.{f.name}", tables)


def _clear(name: str, key: str) -> str:
    """Field names that clash with the label columns get the prefix ``field_``."""
    return f"field_{name}" if name in (key, "dewey", "parent", "ord", "is_null") else name


def node_table(df: DataFrame, key: str, children: str) -> DataFrame:
    """All nodes of all schema paths in one scan: ``key, path, dewey, is_null, n_children``.

    ``n_children`` counts the elements that are not null over all child arrays of a node; it is null
    where the schema gives a node no child arrays.
    """
    nodes = F.concat(_own_node(children, F.lit(""), F.array().cast("array<int>"), F.lit(False), [F.col(children)]), _nodes(F.col(children), df.schema[children].dataType.elementType, children, F.array().cast("array<int>")))
    return df.select(F.col(key), F.explode(nodes).alias("n")).select(key, "n.*")


def _count(arrays: list[Column]) -> Column:
    if not arrays:
        return F.lit(None).cast("int")
    total = F.lit(0)
    for a in arrays:
        total = total + F.coalesce(F.size(F.filter(a, lambda x: x.isNotNull())), F.lit(0))
    return total.cast("int")


def _own_node(_: str, path: Column, dewey: Column, is_null: Column, arrays: list[Column]) -> Column:
    count = F.greatest(_count(arrays), F.lit(0)) if arrays else _count(arrays)
    return F.array(F.struct(path.alias("path"), dewey.alias("dewey"), is_null.alias("is_null"), count.alias("n_children")))


def _nodes(array: Column, kind: T.StructType, path: str, prefix: Column) -> Column:
    inner = [f for f in kind.fields if _is_children(f.dataType)]

    def each(x: Column, i: Column) -> Column:
        label = F.concat(prefix, F.array(i))
        own = _own_node(path, F.lit(path), label, x.isNull(), [x[f.name] for f in inner])
        return F.concat(own, *[_nodes(x[f.name], f.dataType.elementType, f"{path}.{f.name}", label) for f in inner])

    return F.coalesce(F.flatten(F.transform(array, each)), F.array().cast("array<struct<path:string,dewey:array<int>,is_null:boolean,n_children:int>>"))
