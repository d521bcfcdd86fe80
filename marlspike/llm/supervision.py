"""Quality rules combined by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the corpus estimates how often each rule votes
each way on good and on bad documents, and the share of good ones; a document's verdict is its posterior probability
of being good, not whether it passed every rule. The corpus enters as counts of vote patterns (at most 3 to the
number of rules, pre-aggregated), so estimation covers every document and its size is bounded by the rules alone.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows count as often as they
occur and get equal verdicts; an empty table gives an empty result; a null identifier stays null; other columns do
not matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marlspike.llm import stats
from marlspike.llm.text import texts_of
from marlspike.session import materialize, ship

#: name: (statistic, bad if, good if). A rule abstains between the two; each is a ratio over words or characters.
RULES = {
    "length": ("n_words", "< 10", ">= 10"),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", "> 0.2", "<= 0.05"),
    "symbols": ("n_symbols / greatest(n_words, 1)", "> 0.1", "<= 0.02"),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", "> 0.8", "<= 0.5"),
    "capitals": ("upper / greatest(letters, 1)", "> 0.4", "<= 0.15"),
    "word_length": ("word_chars / greatest(n_words, 1)", "> 12", "between 3 and 9"),
    "commonest": ("commonest / greatest(n_words, 10)", "> 0.35", "<= 0.25"),
    "letters": ("letters / greatest(word_chars, 1)", "< 0.6", ">= 0.7"),
    "bangs": ("bangs / greatest(n_words, 1)", "> 0.3", "<= 0.05"),
    "neighbours": ("adjacent / greatest(n_words, 1)", "> 0.2", "<= 0.05"),
}
BAD, ABSTAIN, GOOD = 0, 1, 2


def vote(rule: str) -> Column:
    value, bad, good = RULES[rule]
    return F.expr(f"case when {value} {bad} then {BAD} when {value} {good} then {GOOD} else {ABSTAIN} end")


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good documents, log odds[rule, vote]) by expectation-maximisation from the all-must-pass verdict."""
    n, k = votes.shape
    if not len(counts) or not counts.sum():
        return 0.5, np.zeros((k, 3))
    post = np.where((votes == BAD).any(1), 0.05, 0.95)  # the start: all rules must pass; the rounds weigh them
    for _ in range(rounds):
        share = float((post * counts).sum() + 1) / (counts.sum() + 2)
        odds = np.zeros((k, 3))
        for r in range(k):
            hit = votes[:, r, None] == np.arange(3)
            good, bad = ((w * counts)[:, None] * hit for w in (post, 1 - post))
            odds[r] = np.log((good.sum(0) + 1) / (good.sum() + 3)) - np.log((bad.sum(0) + 1) / (bad.sum() + 3))
        odds[:, GOOD] = np.maximum(odds[:, GOOD], 0)  # a rule is never taken for its opposite
        odds[:, BAD] = np.minimum(odds[:, BAD], 0)
        logit = np.log(share / (1 - share)) + odds[np.arange(k), votes].sum(1)
        fresh = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        moved, post = np.abs(fresh - post).max(), fresh
        if moved < 1e-9:
            break
    return share, odds


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics of `stats.Stats`, base_failed, quality (posterior) and kept for every row."""
    ship(docs.sparkSession)

    @F.pandas_udf(f"struct<{', '.join(f'{f}: long' for f in stats.Stats._fields)}>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats.of(t) for t in texts_of(texts)], columns=stats.Stats._fields, dtype="int64")

    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), measure(text_col).alias("s")).select("doc_id", "s.*"), "stats")
    voted = rows.select("*", *[vote(r).alias(f"vote_{r}") for r in RULES])
    names = [f"vote_{r}" for r in RULES]
    patterns = voted.groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in patterns], int).reshape(-1, len(names))
    share, odds = estimate(votes, np.array([r["count"] for r in patterns], float))
    terms = [F.element_at(F.array(*[F.lit(float(x)) for x in odds[i]]), F.col(n) + 1) for i, n in enumerate(names)]
    logit = reduce(lambda a, b: a + b, terms, F.lit(float(np.log(share / (1 - share)))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-logit)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names)
