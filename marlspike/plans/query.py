"""The query builder: one index range, residual filters, order, then take, collect or paginate.

The builder only assembles a DataFrame; Catalyst pushes the range into the scan, prunes columns and turns an ordered
limit into a top-k per partition. An index is a list of columns, always followed by creation time and identifier, so
its order is total.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from marlspike.functions.hashing import parse_id
from marlspike.operators.incremental import overlay
from marlspike.operators.prefix import numbered
from marlspike.plans.predicates import all_of, bag, residual


@dataclass(frozen=True)
class IndexSpec:
    """An index of a table: its name, its columns, and the columns that break ties."""

    name: str
    columns: tuple[str, ...]
    tie: tuple[str, ...]

    @property
    def order(self) -> tuple[str, ...]:
        return self.columns + tuple(c for c in self.tie if c not in self.columns)


@dataclass
class Page:
    """A page: its rows in order, where to go on, whether there is more, and whether the scan limit cut it short.

    It owns the keys past `after` (a cursor, null from the start), up to and with `upto` (null to the end): the last row's
    key if there is more. A page without rows owns all that is left.
    """

    rows: list
    next_cursor: str | None
    has_more: bool
    scan_capped: bool
    after: str | None = None
    upto: str | None = None


class CursorError(ValueError):
    """A cursor that cannot be used; `code` is malformed, version or kind."""

    def __init__(self, code: str):
        super().__init__(f"{code} cursor")
        self.code = code


def encode_position(kind: str, value) -> str:
    """A cursor of a kind: `simple` (an offset or token) or `index` (the values of an index key)."""
    if kind not in ("simple", "index"):
        raise CursorError("kind")
    return encode_cursor([kind, *(value if kind == "index" else [value])])


def decode_position(cursor: str, kind: str):
    """The value of a cursor of that kind."""
    found, *values = decode_cursor(cursor)
    if found != kind:
        raise CursorError("kind")
    return values if kind == "index" else values[0]


def encode_cursor(values: list) -> str:
    """An opaque cursor over typed values."""

    def tag(v):
        if isinstance(v, dt.datetime):
            return {"t": v.isoformat()}
        return {"b": base64.b64encode(v).decode()} if isinstance(v, bytes | bytearray) else v

    return base64.urlsafe_b64encode(json.dumps({"v": 1, "key": [tag(v) for v in values]}).encode()).decode()


def decode_cursor(cursor: str) -> list:
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        version, values = body["v"], body["key"]
    except Exception as e:
        raise CursorError("malformed") from e
    if version != 1:
        raise CursorError("version")

    def untag(v):
        if isinstance(v, dict):
            return dt.datetime.fromisoformat(v["t"]) if "t" in v else base64.b64decode(v["b"])
        return v

    return [untag(v) for v in values]


def after(columns: tuple[str, ...], values: list, descending: bool) -> Column:
    """Rows past the given key in the index order, as a chain of comparisons; nulls are lowest."""

    def past(c: str, v: Any) -> Column:
        if descending:
            return F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < F.lit(v))
        return F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))

    out = F.lit(False)
    for i in range(len(columns) - 1, -1, -1):
        same = F.col(columns[i]).eqNullSafe(F.lit(values[i]))
        out = past(columns[i], values[i]) | (same & out)
    return out


@dataclass(frozen=True)
class Query:
    """An immutable query over one index of one DataFrame."""

    df: DataFrame
    index: IndexSpec
    range_terms: tuple = ()
    filters: tuple = ()
    descending: bool = False
    limit: int | None = None
    policy: Any = None

    def eq(self, name: str, value: Any) -> Query:
        return replace(self, range_terms=(*self.range_terms, ("eq", name, value)))

    def gt(self, name: str, value: Any) -> Query:
        return replace(self, range_terms=(*self.range_terms, ("gt", name, value)))

    def gte(self, name: str, value: Any) -> Query:
        return replace(self, range_terms=(*self.range_terms, ("gte", name, value)))

    def lt(self, name: str, value: Any) -> Query:
        return replace(self, range_terms=(*self.range_terms, ("lt", name, value)))

    def lte(self, name: str, value: Any) -> Query:
        return replace(self, range_terms=(*self.range_terms, ("lte", name, value)))

    def where(self, op: str | Column, name: str | None = None, value: Any = None) -> Query:
        """A residual filter: an operator, a field and a value, or a two-valued column. Filters add up."""
        return replace(self, filters=(*self.filters, op if isinstance(op, Column) else residual(op, name, value)))

    def fields(self, **bags: Any) -> Query:
        """Residual filters as field-operator bags."""
        return replace(self, filters=(*self.filters, *[bag(n, b) for n, b in bags.items()]))

    def order(self, direction: str) -> Query:
        return replace(self, descending={"asc": False, "desc": True}[direction])

    def bounds(self) -> tuple[list[Column], list[str]]:
        """The index range as conditions, and the range terms that it cannot use.

        Equality terms bind the index columns from the left, the first one on a column; the next column may have
        bounds, the last one each way. Every other range term neither narrows nor filters.
        """
        equal: dict[str, Any] = {}
        low: dict[str, tuple] = {}
        high: dict[str, tuple] = {}
        for op, name, value in self.range_terms:
            if op == "eq":
                equal.setdefault(name, value)
            else:
                (low if op in ("gt", "gte") else high)[name] = (op, value)
        conditions, used = [], set()
        for c in self.index.columns:
            if c in equal:
                conditions.append(F.col(c).eqNullSafe(F.lit(equal[c])))
                used.add(c)
                continue
            if c in low:
                op, v = low[c]
                conditions.append(F.col(c).isNotNull() if v is None and op == "gt" else F.lit(True) if v is None else F.col(c) > F.lit(v) if op == "gt" else F.col(c) >= F.lit(v))
            if c in high:
                op, v = high[c]
                under = F.lit(False) if v is None and op == "lt" else F.col(c).isNull() if v is None else F.col(c) < F.lit(v) if op == "lt" else F.col(c) <= F.lit(v)
                conditions.append(under if c in low or v is None else F.col(c).isNull() | under)
            if c in low or c in high:
                used.add(c)
            break
        return conditions, [t[1] for t in self.range_terms if t[1] not in used]

    def scan(self) -> DataFrame:
        """The index range, without residual filters."""
        conditions, _ = self.bounds()
        return self.df.where(all_of(conditions)) if conditions else self.df

    def sort_keys(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if self.descending else F.col(c).asc_nulls_first() for c in self.index.order]

    def matching(self) -> DataFrame:
        df = self.scan()
        for f in (*self.filters, *([self.policy] if self.policy is not None else [])):
            df = df.where(f)
        return df

    def collect_frame(self) -> DataFrame:
        """All matches, or the first `limit`, in order. Lazy, as every DataFrame."""
        df = self.matching().orderBy(*self.sort_keys())
        return df if self.limit is None else df.limit(self.limit)

    def take(self, n: int) -> DataFrame:
        """The first n matches after residual filters; none for 0."""
        return replace(self, limit=n).collect_frame()

    def page_frame(self, page_size: int, cursor: str | None = None, max_scan: int | None = None) -> DataFrame:
        """The rows of a page, by keyset: the range past the cursor, at most `max_scan` rows examined, then filtered."""
        df = self.scan()
        if cursor is not None:
            df = df.where(after(self.index.order, decode_cursor(cursor), self.descending))
        if max_scan is not None:
            df = df.orderBy(*self.sort_keys()).limit(max_scan)
        for f in (*self.filters, *([self.policy] if self.policy is not None else [])):
            df = df.where(f)
        return df.orderBy(*self.sort_keys()).limit(page_size)

    def paginate(self, page_size: int, cursor: str | None = None, max_scan: int | None = None) -> Page:
        """One page. One match more than the page is fetched to see whether there is more."""
        page = self._page(page_size, cursor, max_scan)
        last = encode_cursor([page.rows[-1][c] for c in self.index.order]) if page.rows and page.has_more else None
        return replace(page, after=cursor, upto=last)

    def over_staged(self, staged: DataFrame, key: str) -> Query:
        """The query over its rows with a transaction's own staged writes (with `op` put or delete) laid over them."""
        return replace(self, df=overlay(self.df, staged, key))

    def pinned(self, shard_key: str) -> Query:
        """The query, if it reads one shard: its index starts with the shard key, and an equality binds it. Else raises."""
        if self.index.columns[:1] != (shard_key,) or not any(op == "eq" and name == shard_key for op, name, _ in self.range_terms):
            raise ValueError(f"a scan inside a shard has to pin {shard_key!r} by equality on an index that starts with it")
        return self

    def _page(self, page_size: int, cursor: str | None, max_scan: int | None) -> Page:
        order = self.index.order
        rows = self.page_frame(page_size + 1, cursor, max_scan).collect()
        page, extra = rows[:page_size], len(rows) > page_size
        key = lambda r: encode_cursor([r[c] for c in order])
        if max_scan is None or extra:
            return Page(page, key(page[-1]) if extra and page else None, extra, False)
        scan = self.scan()
        if cursor is not None:
            scan = scan.where(after(order, decode_cursor(cursor), self.descending))
        seen = scan.orderBy(*self.sort_keys()).limit(max_scan).select(*order)
        last = seen.agg(F.count("*").alias("n"), (F.min if self.descending else F.max)(F.struct(*order)).alias("last")).first()
        if last["n"] < max_scan:
            return Page(page, None, False, False)
        if len(page) == page_size:
            return Page(page, key(page[-1]) if page else None, True, False)
        return Page(page, encode_cursor(list(last["last"])), True, True)

    def page_bounds(self, page_size: int) -> DataFrame:
        """Each page of the whole result: its first and last key, its rows, and the key at which the next page starts."""
        keys = numbered(self.matching().select(*self.index.order), self.sort_keys(), "_place")
        key = F.struct(*self.index.order)
        ends = (F.max, F.min) if self.descending else (F.min, F.max)
        paged = keys.withColumn("page", F.floor((F.col("_place") - 1) / page_size))
        pages = paged.groupBy("page").agg(ends[0](key).alias("first"), ends[1](key).alias("last"), F.count("*").alias("n"))
        return pages.join(pages.select((F.col("page") - 1).alias("page"), F.col("first").alias("next_first")), "page", "left")

    def diffable(self, reads: int = 1, returned_untouched: bool = True) -> str | None:
        """How changes reach a standing query: "range", or "page" with a limit; None if it has to run again.

        Row-level diffs need a single bare read whose result is returned untouched, with no policy. `standing.classify`
        does this for a table of runs, by-id reads and cut pages included.
        """
        bare = reads == 1 and returned_untouched and self.policy is None
        return ("range" if self.limit is None else "page") if bare else None


@dataclass
class Catalog:
    """Tables by name, each with its indexes by name; every table has `by_creation` and `by_id` besides."""

    frames: dict[str, DataFrame]
    tie: tuple[str, ...]
    indexes: dict[str, dict[str, tuple[str, ...]]]

    def query(self, table: str, index: str = "by_creation") -> Query:
        """A query over one index of a table; a table or index that is not known raises."""
        if table not in self.frames:
            raise KeyError(f"unknown table {table!r}")
        known = {"by_creation": (), "by_id": self.tie[-1:], **self.indexes.get(table, {})}
        if index not in known:
            raise KeyError(f"unknown index {index!r} of {table!r}")
        return Query(self.frames[table], IndexSpec(index, tuple(known[index]), self.tie))

    def get(self, table: str, doc_id: str, policy: Column | None = None) -> DataFrame:
        """The document of an identifier: no row if it is absent or the policy hides it; a malformed identifier raises."""
        parse_id(doc_id)
        found = self.query(table, "by_id").eq(self.tie[-1], doc_id).scan().limit(1)
        return found if policy is None else found.where(policy)


def over(df: DataFrame, columns: list[str], tie: list[str], name: str = "by_columns") -> Query:
    return Query(df, IndexSpec(name, tuple(columns), tuple(tie)))
