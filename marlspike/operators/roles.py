"""Roles: what they inherit, the `resource:action` patterns that they grant, and the rows that assignments call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.functions.hashing import fnv, low_bytes, stable_json
from marlspike.operators.jobs import reconcile
from marlspike.session import discard, materialize


def expand(spark: SparkSession, inherits: DataFrame, grants: DataFrame) -> DataFrame:
    """(role, pattern): own and inherited patterns of every role, at any depth; a written table.

    `inherits` has (role, parent), `grants` (role, resource, action). Each round hands new patterns from parents to
    their heirs, so cycles end; a parent that nothing defines grants nothing.
    """
    edges = inherits.select("role", "parent").distinct()
    fresh = have = materialize(grants.select("role", F.concat_ws(":", "resource", "action").alias("pattern")).distinct(), "patterns")
    while True:
        passed = fresh.select(F.col("role").alias("parent"), "pattern").join(edges, "parent").select("role", "pattern").distinct()
        new = materialize(passed.join(have, ["role", "pattern"], "left_anti"), "patterns")
        if new.isEmpty():
            discard(new)
            return have
        grown = materialize(have.union(new), "patterns")
        if fresh is not have:
            discard(fresh)
        discard(have)
        fresh, have = new, grown


def wanted(assignments: DataFrame, patterns: DataFrame) -> DataFrame:
    """(user_id, scope_type, scope_id, permission) that assignments (user_id, role, scope_type, scope_id) call for."""
    met = assignments.join(patterns, "role")
    return met.select("user_id", "scope_type", "scope_id", F.col("pattern").alias("permission")).distinct()


def repairs(have: DataFrame, assignments: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of the permission index to insert and to delete, with `action`."""
    want = wanted(assignments, patterns)
    return reconcile(have.select(*want.columns), want)


def config_hash(roles: dict, permissions: dict) -> str:
    """The version stamp of a configuration: FNV-1a over its JSON with sorted keys, in hexadecimal."""
    units = stable_json({"roles": roles, "permissions": permissions}).encode("utf-16-le", "surrogatepass")
    h = 0x811C9DC5
    for low, high in zip(units[::2], units[1::2]):
        h = (h ^ (low | high << 8)) * 0x01000193 % 2**32
    return f"{h:x}"


def data_hash(text: str) -> int:
    return fnv(low_bytes(text))
