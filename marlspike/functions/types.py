"""Document types: validators as plain dictionaries, compiled to Spark types and to validation columns.

A validator is {"type": ...}: null, boolean, number, int64, string, bytes, any, id (table), literal (value), array
(items), record (values), object (fields), union (members); a field may carry "optional": True.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

SCALARS = {"null": T.NullType(), "boolean": T.BooleanType(), "number": T.DoubleType(), "int64": T.LongType(), "string": T.StringType(), "bytes": T.BinaryType(), "id": T.StringType(), "any": T.VariantType()}
#: Rank of types in the total order of values.
RANKS = {"null": 0, "boolean": 1, "number": 2, "int64": 3, "string": 4, "bytes": 5, "array": 6, "object": 7}
#: Column types of the relational store.
DDL = {"boolean": "INTEGER", "number": "REAL", "int64": "TEXT", "string": "TEXT", "id": "TEXT", "bytes": "BLOB"}


def spark_type(v: dict) -> T.DataType:
    kind = v["type"]
    if kind in SCALARS:
        return SCALARS[kind]
    if kind == "literal":
        return SCALARS[{bool: "boolean", float: "number", int: "int64", str: "string", bytes: "bytes", type(None): "null"}[type(v["value"])]]
    if kind == "array":
        return T.ArrayType(spark_type(v["items"]))
    if kind == "record":
        return T.MapType(T.StringType(), spark_type(v["values"]))
    if kind == "object":
        return T.StructType([T.StructField(n, spark_type(f), nullable(f), {"ref": f["table"]} if f["type"] == "id" else {}) for n, f in v["fields"].items()])
    if kind == "union":
        made = [spark_type(m) for m in v["members"] if m["type"] != "null"]
        return made[0] if made and all(m == made[0] for m in made) else T.VariantType() if made else T.NullType()
    raise ValueError(f"unknown validator {kind!r}")


def nullable(v: dict) -> bool:
    return bool(v.get("optional")) or v["type"] in ("null", "any") or v["type"] == "union" and any(nullable(m) for m in v["members"])


def ddl(table: str, v: dict, unique: dict[str, list[str]] | None = None) -> list[str]:
    """Create-only statements of a table of the relational store."""
    cols = [f'"{n}" {DDL.get(f["type"], "TEXT")}' for n, f in v["fields"].items()]
    out = [f'CREATE TABLE IF NOT EXISTS "{table}" ("_id" TEXT PRIMARY KEY, "_creationTime" REAL NOT NULL, {", ".join(cols)})']
    return out + [f'CREATE UNIQUE INDEX IF NOT EXISTS "{table}_{i}" ON "{table}" ({", ".join(f"\"{c}\"" for c in cs)})' for i, cs in (unique or {}).items()]


def problems(v: dict, value: Any, path: str = "") -> list[dict]:
    """What is wrong with a Python value: a list of path and message. Objects are closed."""
    kind = v["type"]
    fits = {
        "null": lambda: value is None, "boolean": lambda: isinstance(value, bool), "number": lambda: isinstance(value, float),
        "int64": lambda: isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63, "string": lambda: isinstance(value, str),
        "id": lambda: isinstance(value, str), "bytes": lambda: isinstance(value, bytes), "any": lambda: True,
        "literal": lambda: type(value) is type(v["value"]) and value == v["value"],
    }
    if kind in fits:
        return [] if fits[kind]() else [{"path": path, "message": f"expected {kind}"}]
    if kind == "array":
        if not isinstance(value, list):
            return [{"path": path, "message": "expected array"}]
        return [p for i, x in enumerate(value) for p in problems(v["items"], x, f"{path}[{i}]")]
    if kind == "union":
        return [] if any(not problems(m, value, path) for m in v["members"]) else [{"path": path, "message": "no member fits"}]
    if not isinstance(value, dict):
        return [{"path": path, "message": f"expected {kind}"}]
    at = lambda n: f"{path}.{n}" if path else n
    if kind == "record":
        return [p for n, x in value.items() for p in problems(v["values"], x, at(n))]
    out = []
    for n, f in v["fields"].items():
        if n in value:
            out += problems(f, value[n], at(n))
        elif not f.get("optional"):
            out.append({"path": at(n), "message": "missing"})
    return out + [{"path": at(n), "message": "unexpected field"} for n in value if n not in v["fields"]]


def validation(columns: dict[str, dict], most: int = 3) -> Column:
    """For typed columns: an array of the first messages about null required fields and wrong literals."""
    checks = []
    for name, v in columns.items():
        c = F.col(name)
        if not nullable(v):
            checks.append(F.when(c.isNull(), F.lit(f"{name}: missing")))
        literals = [m["value"] for m in v["members"] if m["type"] == "literal"] if v["type"] == "union" else [v["value"]] if v["type"] == "literal" else []
        if literals:
            checks.append(F.when(c.isNotNull() & ~c.isin(*literals), F.lit(f"{name}: not allowed")))
    return F.slice(F.array_compact(F.array(*checks)), 1, most) if checks else F.array().cast("array<string>")


def schema_changes(old: dict, new: dict) -> list[str]:
    """Why a schema of tables cannot replace another: only additions are allowed."""
    out = []
    for table, v in old.items():
        if table not in new:
            out.append(f"{table}: removed")
            continue
        before, after = v["fields"], new[table]["fields"]
        for n, f in before.items():
            if n not in after:
                out.append(f"{table}.{n}: removed")
            elif {**f, "optional": None} != {**after[n], "optional": None}:
                out.append(f"{table}.{n}: type changed")
            elif f.get("optional") and not after[n].get("optional"):
                out.append(f"{table}.{n}: now required")
        out += [f"{table}.{n}: new and required" for n, f in after.items() if n not in before and not f.get("optional")]
    return out


def sort_key(variant: Column) -> Column:
    """A sortable struct for untyped values: rank, then number, integer, string. Arrays and objects go by their JSON."""
    kind = F.schema_of_variant(variant)
    rank = F.when(variant.isNull() | (kind == "VOID"), 0).when(kind == "BOOLEAN", 1).when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), 2)
    rank = rank.when(kind == "BIGINT", 3).when(kind == "STRING", 4).when(kind == "BINARY", 5).when(kind.startswith("ARRAY"), 6).otherwise(7)
    as_ = lambda t: F.try_variant_get(variant, "$", t)
    return F.struct(
        rank.alias("rank"), F.when(rank == 1, as_("boolean").cast("int")).alias("flag"), F.when(rank == 2, as_("double")).alias("number"),
        F.when(rank == 3, as_("bigint")).alias("whole"), F.when(rank >= 4, as_("string")).alias("text"),
    )


def field(path: str, json: Column) -> Column:
    """A dotted path in a JSON text; null if any step is absent or no object."""
    return F.get_json_object(json, "$." + path)
