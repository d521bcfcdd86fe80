"""Secret scan with corpus-wide ownership frequency.

Base kinds, leftmost and non-overlapping per kind, offsets in code points, end exclusive:
assign, a credential word assigned a value of 8 or more characters; access, an access key identifier of 16 or more;
hex, a lower-case hexadecimal run of 32 or more. A further kind, `entropy`, proposes other tokens of 20 or more
characters that mix letters and digits and look random.

The hash of each candidate's value is aggregated over the whole corpus by distinct repositories and owners; a repository
belongs to its owner. A value that more than `owners` owners hold, or that is in more than `repos` repositories, is a
widely copied example; any other is owner-specific and taken as live. Base spans stay whatever the verdict; an
`entropy` span is reported only if its value is live. The columns n_owners and n_repos give the widest spread among a
document's values.

Defined cases: null and empty texts have no spans; repeated rows are separate rows with equal spans, and their value
counts once for its owner; a null owner or repository is one owner of its own; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from marlspike.llm.text import texts_of
from marlspike.session import materialize, ship

#: Fixed patterns of the base kinds; kinds are listed in this order.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens of any length, dots inside included; dots at either end are not part of one.
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-])[A-Za-z0-9+/_=.-]{19,}[A-Za-z0-9+/_=-]")


def looks_random(value: str, bits: float = 3.5) -> bool:
    """Letters of both cases and digits, and `bits` bits of entropy a character or more."""
    if not (re.search(r"\d", value) and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= bits


def scan(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the value) of every candidate, in order of start, then kind."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b, _ in found]
    found += [(3, m.start(), m.end(), m[0]) for m in RANDOM.finditer(text) if looks_random(m[0]) and not any(a < m.end() and m.start() < b for a, b in taken)]
    return sorted(((k, a, b, xxhash.xxh64_intdigest(v) - 2**63) for k, a, b, v in found), key=lambda s: (s[1], s[0]))


def ownership(spans: DataFrame) -> DataFrame:
    """(value, owners, repos): distinct holders of each value hash; `spans` has columns value, owner, repo.

    Counted in steps, each combined before its shuffle, so a value with very many uses is one row per task.
    """
    pairs = spans.select("value", "owner", "repo").distinct()
    by_owner = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), owners: int = 2, repos: int = 4) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_owners, n_repos."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:int,start:int,end:int,value:long>>")
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "value": v} for k, a, b, v in scan(t)] for t in texts_of(texts)])

    def joined(spans):
        name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    owner, repo = F.coalesce(F.col(owner_col), F.lit("\0")), F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("\0")) for c in repo_cols])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), owner.alias("owner"), repo.alias("repo"), scanned(text_col).alias("found"))
    rows = materialize(rows, "secrets")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    judged = each.select("row", "kind", "start", "end", "value").join(ownership(each), "value")
    judged = judged.withColumn("live", (F.col("owners") <= owners) & (F.col("repos") <= repos))
    shown = F.col("live") | (F.col("kind") < 3)
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("start", "kind", "end")))).alias("all_spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live") & shown).alias("n_example"),
        F.max("owners").alias("n_owners"),
        F.max("repos").alias("n_repos"),
    )
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    left = rows.select("row", "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], joined(base).alias("base"))
    out = left.join(by_row, "row", "left")
    spans = F.coalesce(joined(F.col("all_spans")), F.lit(""))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example", "n_owners", "n_repos")])
