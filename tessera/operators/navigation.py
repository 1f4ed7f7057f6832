"""Tree navigation as joins over the node table.

Every node lists what is around it (ancestors, scopes), so "within" and "around" are equalities on (file, id):
the work is in proportion to what comes out, not to the square of a file's nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.globs import star_to_regex

_KEY = ["file", "node_id"]


def parent(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """of (file, node_id) with parent_id and parent_kind; the root has none."""
    up = nodes.select("file", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    return of.select(*_KEY).join(nodes.select(*_KEY, "parent_id"), _KEY).join(up, ["file", "parent_id"], "left")


def children(of: DataFrame, nodes: DataFrame, named: bool = False) -> DataFrame:
    """(file, node_id, child_id, child_idx, child_kind) in any order; named leaves out tokens."""
    kids = nodes.filter("named") if named else nodes
    kids = kids.select("file", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), "child_idx", F.col("kind").alias("child_kind"))
    return of.select(*_KEY).join(kids, _KEY)


def ancestors(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, node_id, ancestor_id, ancestor_kind, ancestor_depth), without the node itself; the innermost has the greatest depth."""
    at = of.select(*_KEY).join(nodes.select(*_KEY, "ancestors"), _KEY).select(*_KEY, F.explode("ancestors").alias("ancestor_id"))
    up = nodes.select("file", F.col("node_id").alias("ancestor_id"), F.col("kind").alias("ancestor_kind"), F.col("depth").alias("ancestor_depth"))
    return at.join(up, ["file", "ancestor_id"]).select(*_KEY, "ancestor_id", "ancestor_kind", "ancestor_depth")


def closest_ancestor(of: DataFrame, nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """(file, node_id, ancestor_id): the innermost ancestor that is among matched (file, node_id)."""
    at = of.select(*_KEY).join(nodes.select(*_KEY, "ancestors"), _KEY).select(*_KEY, F.posexplode("ancestors").alias("place", "ancestor_id"))
    hit = at.join(matched.select("file", F.col("node_id").alias("ancestor_id")).distinct(), ["file", "ancestor_id"], "left_semi")
    return hit.groupBy(*_KEY).agg(F.min_by("ancestor_id", "place").alias("ancestor_id"))


def subtree(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, node_id, inner_id, inner_kind): the node itself and all below it."""
    around = F.explode(F.concat(F.array("node_id"), F.col("ancestors"))).alias("top")
    inner = nodes.select("file", around, F.col("node_id").alias("inner_id"), F.col("kind").alias("inner_kind"))
    return of.select(*_KEY).join(inner.withColumnRenamed("top", "node_id"), _KEY).select(*_KEY, "inner_id", "inner_kind")


def query_subtree(of: DataFrame, nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """(file, node_id, inner_id): the nodes among matched (file, node_id), which a query found, that lie in each node of `of`."""
    inner = matched.select("file", F.col("node_id").alias("inner_id")).distinct()
    at = inner.join(nodes.select("file", F.col("node_id").alias("inner_id"), "ancestors"), ["file", "inner_id"])
    at = at.select("file", "inner_id", F.explode(F.concat(F.array("inner_id"), F.col("ancestors"))).alias("node_id"))
    return of.select(*_KEY).join(at, _KEY).select(*_KEY, "inner_id")


def bindings(of: DataFrame, nodes: DataFrame, scopes: DataFrame, decls: DataFrame) -> DataFrame:
    """of (file, node_id) identifiers with what declares their name: binding, module, imported, shadowed.

    The innermost enclosing scope that declares the name holds; a class scope is not seen from functions
    within it. Nothing declared: no row. shadowed: more than one enclosing scope declares it.
    """
    at = of.select(*_KEY).join(nodes.select(*_KEY, "scopes", F.col("text").alias("name")), _KEY)
    at = at.select(*_KEY, "name", F.posexplode("scopes").alias("place", "scope_id"))
    first = decls.groupBy("file", "scope_id", "name").agg(F.min_by(F.struct(F.col("kind").alias("binding"), "module", "imported"), F.when(F.col("kind") == "import", 0).otherwise(1)).alias("x"))
    found = at.join(first, ["file", "scope_id", "name"])
    out = found.groupBy(*_KEY).agg(F.min_by("x", "place").alias("x"), F.countDistinct("scope_id").alias("n"))
    return out.select(*_KEY, "x.binding", "x.module", "x.imported", (F.col("n") > 1).alias("shadowed"))


def resolves_to_import(bound: DataFrame, module: str, name: str | None = None) -> DataFrame:
    """The rows of bindings() that are imported from exactly this module; name: the export, `default` or `*`."""
    hit = (F.col("binding") == "import") & (F.col("module") == module)
    return bound.filter(hit if name is None else hit & (F.col("imported") == name))


def imported_from(bound: DataFrame, pattern: str) -> DataFrame:
    """The rows of bindings() that are imported from a module that a `*` pattern fits."""
    return bound.filter((F.col("binding") == "import") & F.col("module").rlike(star_to_regex(pattern)))
