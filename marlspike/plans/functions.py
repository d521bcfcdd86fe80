"""Named functions over a document store: queries give a DataFrame, mutations a batch of operations.

Arguments are validated before a function runs. A function gets a context: the session, the store as of its snapshot, a
fixed clock and a seeded random stream, so that running it again gives the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from marlspike.functions.hashing import random_stream
from marlspike.functions.types import problems
from marlspike.sources import documents, log as doclog


@dataclass
class Context:
    spark: SparkSession
    log: DataFrame
    snapshot: int
    now: float
    seed: int = 0

    def __post_init__(self):
        self._stream = random_stream(self.seed)

    def db(self) -> DataFrame:
        """The live documents as of the snapshot."""
        return doclog.as_of(self.log, self.snapshot)

    def random(self) -> float:
        return next(self._stream)


@dataclass
class Function:
    kind: str
    args: dict
    handler: Callable[..., DataFrame]
    returns: list[str] | None = None


@dataclass
class Registry:
    """Functions by name, and the checks that every write of a mutation has to pass."""

    valid: Callable[[str], Column] | None = None
    policy: Callable[[str], Column] | None = None
    unique: list[str] = field(default_factory=list)
    functions: dict[str, Function] = field(default_factory=dict)

    def register(self, name: str, kind: str, args: dict, returns: list[str] | None = None):
        if kind not in ("query", "mutation"):
            raise ValueError(f"unknown kind of function {kind!r}")

        def add(handler):
            self.functions[name] = Function(kind, {"type": "object", "fields": args}, handler, returns)
            return handler

        return add

    def _call(self, name: str, kind: str, context: Context, args: dict[str, Any]) -> DataFrame:
        f = self.functions.get(name)
        if f is None or f.kind != kind:
            raise KeyError(f"no {kind} {name!r}")
        if wrong := problems(f.args, args):
            raise ValueError("; ".join(f"{p['path']}: {p['message']}" for p in wrong[:3]))
        out = f.handler(context, **args)
        if f.returns is not None and out.columns != f.returns:
            raise ValueError(f"{name!r} gives {out.columns}, not {f.returns}")
        return out

    def query(self, name: str, context: Context, **args: Any) -> DataFrame:
        return self._call(name, "query", context, args)

    def mutate(self, name: str, context: Context, ts: int, created: str = "created", **args: Any) -> DataFrame:
        """The log after a mutation that commits at `ts`; raises, and writes nothing, if one of its operations is refused."""
        ops = self._call(name, "mutation", context, args)
        judged = documents.judge(doclog.upto(context.log, context.snapshot), ops, self.valid, self.policy, self.unique)
        bad = judged.where("refused is not null").select("doc_id", "op", "refused").first()
        if bad is not None:
            raise ValueError(f"{bad.op} of {bad.doc_id}: {bad.refused}")
        return context.log.unionByName(documents.revisions(judged, ts, created))
