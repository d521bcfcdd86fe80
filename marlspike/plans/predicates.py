"""Predicates with two-valued logic, index ranges, and relation clauses as semi and anti joins.

Two kinds of comparison exist. A *residual* comparison on a missing (null) field is false, so its negation is true. An
*index* bound goes by the total order, in which null comes first: without a lower bound, `lt` and `lte` admit nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

OPS = ("eq", "neq", "lt", "lte", "gt", "gte")
#: Field operators of the where-tree and the residual operators they stand for.
BAG = {"eq": "eq", "ne": "neq", "lt": "lt", "lte": "lte", "gt": "gt", "gte": "gte"}
MAX_DEPTH = 4


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def residual(op: str, name: str, value: Any) -> Column:
    """`name op value`, false on a missing field. A null value only equals a null that is there, so it is false here."""
    c, v = F.col(name), F.lit(value)
    made = {"eq": c == v, "neq": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}
    if op not in made:
        raise ValueError(f"unknown operator {op!r}")
    return two_valued(made[op])


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def bag(name: str, ops: Any) -> Column:
    """A bag of field operators, all of which hold; a bare value means equality; an empty bag is true."""
    if not isinstance(ops, dict):
        return residual("eq", name, ops)
    parts = []
    for op, value in ops.items():
        if op == "in":
            parts.append(any_of([residual("eq", name, v) for v in value]))
        elif op == "notIn":
            parts.append(all_of([residual("neq", name, v) for v in value]))
        elif op == "isNull":
            parts.append(F.col(name).isNull() if value else F.col(name).isNotNull())
        elif op in BAG:
            parts.append(residual(BAG[op], name, value))
        else:
            raise ValueError(f"unknown field operator {op!r}")
    return all_of(parts)


@dataclass(frozen=True)
class Relation:
    """A named edge to another table: to-many by a field of the child, to-one by a field of the parent."""

    table: str
    field: str
    many: bool = True


@dataclass
class Schema:
    """Tables by name, their relations and key columns, for where-trees that cross tables."""

    frames: dict[str, DataFrame]
    keys: dict[str, str]
    relations: dict[str, dict[str, Relation]] = field(default_factory=dict)


def restrict(schema: Schema, table: str, tree: Any, depth: int = 0) -> DataFrame:
    """The rows of `table` that a where-tree admits. True and None admit all, False none.

    Relation clauses in conjunction become left-semi and left-anti joins; under OR and NOT they become flags from a
    left join with the distinct matching keys.
    """
    return _apply(schema, table, schema.frames[table], tree, depth)


def _apply(schema: Schema, table: str, df: DataFrame, tree: Any, depth: int) -> DataFrame:
    if tree is True or tree is None:
        return df
    if tree is False:
        return df.where(F.lit(False))
    relations = schema.relations.get(table, {})
    for name, clause in tree.items():
        if name == "AND":
            for sub in clause:
                df = _apply(schema, table, df, sub, depth)
        elif name in ("OR", "NOT"):
            df, condition = _flags(schema, table, df, {name: clause}, depth)
            df = df.where(condition).select(*schema.frames[table].columns)
        elif name in relations:
            for quantifier, leaf in clause.items():
                df = _relate(schema, table, df, relations[name], quantifier, leaf, depth)
        else:
            df = df.where(bag(name, clause))
    return df


def _relate(schema: Schema, table: str, df: DataFrame, rel: Relation, quantifier: str, leaf: Any, depth: int) -> DataFrame:
    if depth >= MAX_DEPTH:
        raise ValueError(f"relations nest deeper than {MAX_DEPTH}")
    key = schema.keys[table]
    if quantifier == "every":
        # Children that fail the leaf disqualify; a leaf that is null counts as failed. No children: vacuously true.
        child, good = schema.frames[rel.table], restrict(schema, rel.table, leaf, depth + 1)
        if _plain(schema, rel.table, leaf):
            failing = child.where(~two_valued(_column(schema, rel.table, leaf)))
        else:
            # Children as whole rows: a key need not be unique, and equal rows are alike good or not.
            own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(child.columns)])
            failing = child.withColumn("_row", own).join(good.select(own.alias("_good")).distinct(), F.col("_row").eqNullSafe(F.col("_good")), "left_anti")
        return df.join(failing.select(F.col(rel.field).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    target = restrict(schema, rel.table, leaf, depth + 1)
    if quantifier in ("some", "none") and rel.many:
        keys = target.select(F.col(rel.field).alias("_k"))
        return df.join(keys, F.col(key) == F.col("_k"), "left_semi" if quantifier == "some" else "left_anti")
    if quantifier in ("is", "isNot") and not rel.many:
        keys = target.select(F.col(schema.keys[rel.table]).alias("_k"))
        if quantifier == "is":
            return df.join(keys, F.col(rel.field) == F.col("_k"), "left_semi")
        # A missing reference fails too, unless nothing matches the leaf at all.
        left = df.join(keys, F.col(rel.field) == F.col("_k"), "left_anti")
        some = keys.limit(1).agg((F.count("*") > 0).alias("_any"))
        return left.crossJoin(F.broadcast(some)).where(F.col(rel.field).isNotNull() | ~F.col("_any")).drop("_any")
    raise ValueError(f"{quantifier!r} does not fit this relation")


def _plain(schema: Schema, table: str, tree: Any) -> bool:
    """Whether a tree has no relation clause."""
    if not isinstance(tree, dict):
        return True
    relations = schema.relations.get(table, {})
    return all(
        all(_plain(schema, table, t) for t in clause) if name in ("AND", "OR") else _plain(schema, table, clause) if name == "NOT" else name not in relations
        for name, clause in tree.items()
    )


def _column(schema: Schema, table: str, tree: Any) -> Column:
    if tree is True or tree is None:
        return F.lit(True)
    if tree is False:
        return F.lit(False)
    parts = []
    for name, clause in tree.items():
        if name == "AND":
            parts.append(all_of([_column(schema, table, t) for t in clause]))
        elif name == "OR":
            parts.append(any_of([_column(schema, table, t) for t in clause]))
        elif name == "NOT":
            parts.append(~_column(schema, table, clause))
        else:
            parts.append(bag(name, clause))
    return all_of(parts)


def _flags(schema: Schema, table: str, df: DataFrame, tree: Any, depth: int) -> tuple[DataFrame, Column]:
    """The tree as a condition over `df` with an extra Boolean column for each relation clause in it."""
    if _plain(schema, table, tree):
        return df, _column(schema, table, tree)
    relations, parts = schema.relations.get(table, {}), []
    for name, clause in tree.items():
        if name in ("AND", "OR"):
            made = []
            for sub in clause:
                df, c = _flags(schema, table, df, sub, depth)
                made.append(c)
            parts.append(all_of(made) if name == "AND" else any_of(made))
        elif name == "NOT":
            df, c = _flags(schema, table, df, clause, depth)
            parts.append(~c)
        elif name in relations:
            for quantifier, leaf in clause.items():
                flag, key = f"_flag{len(df.columns)}", schema.keys[table]
                admitted = _relate(schema, table, schema.frames[table], relations[name], quantifier, leaf, depth)
                admitted = admitted.select(F.col(key).alias(flag + "k"), F.lit(True).alias(flag)).distinct()
                df = df.join(admitted, F.col(key) == F.col(flag + "k"), "left").drop(flag + "k")
                parts.append(two_valued(F.col(flag)))
        else:
            parts.append(bag(name, clause))
    return df, all_of(parts)


def merge_policy(filters: Any, policy: Any) -> Any:
    """Row-level security: the policy's tree and the caller's must both hold."""
    if policy is True or policy is None:
        return filters
    if policy is False or filters is False:
        return False
    return policy if filters is True or filters is None else {"AND": [policy, filters]}
