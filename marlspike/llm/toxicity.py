"""Toxicity by a subsequence string kernel with Nyström landmarks and a support vector machine, over sentences.

Texts are cut into sentences, and a sentence into windows: its words, runs of single letters read as one word, words
without the separators inside them, and neighbours of which one is short, joined, so that a blank inside an insult does
not hide it. Two windows are alike by the gap-weighted subsequences of four characters they share, window ends being
characters too: one that spans s characters weighs DECAY ** s, so an insult with a character inserted or left out
still shares many of its subsequences. Spans over SPAN (weights of an eighth of a tight one's or less) count nothing.
Subsequences are numbered by a 20-bit hash.

Two sentences are compared at their worst windows: a latent support vector machine. Labels reach sentences over a few
rounds: sentences of clean documents are negative; of a toxic document the two sentences that the machine finds worst
are positive, each at its worst window. Landmarks are worst windows of positive sentences and windows of clean ones;
with K the kernel among them, a window's features are its kernel values against the landmarks times K ** -1/2, and a
linear SVM (squared hinge) on these features decides. Its decision is linear in the window's subsequences, so the
trained machine is kept as one weight per subsequence. A text's score is the calibrated mean of its two worst sentences.

Fitting takes at most `per_class` labelled rows of each class (default 1,200), and of their windows `most_windows`
clean ones in a round (default 9,000: a third the commonest, the rest drawn); the first positives are windows in `told`
toxic documents or more (default 6) that are `ratio` times as frequent there as in clean ones (default 20). A fifth of
the rows is kept out of a first fit. Its marks on them and on up to `clean_rows` further clean texts (default 6,000)
set the threshold; the machine itself is then fitted on all rows. Scoring is one narrow pass over whole texts, without a
shuffle.

Defined cases: null, empty and wordless texts score as a text with no sentence over the margin; repeated rows score
alike; without labels of both classes every score is 0; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marlspike.llm.labels import labelled_sample, squash
from marlspike.llm.text import byte_chunks
from marlspike.session import ship

DECAY, SPAN, CODES, LONGEST, WORST = 0.5, 6, 1 << 20, 40, 2
#: Words whose marks a worker keeps.
MEMO = 1_000_000
#: Stands for the end of a line while words are split.
BREAK = "\x02"
EDGES = ".,;:!?\"'()[]{}<>|*#$%&"
INSIDE = re.compile(r"[\W_]+")
#: Characters of the shorter one, and of both, of neighbours that are also read as one window.
SHORTER, BOTH = 3, 8
#: One row in so many is kept out of a first fit, to set the threshold; a missed toxic text weighs so much of an error.
CALIBRATION, TOXIC_WEIGHT = 5, 0.25
OFFSETS = [*combinations(range(1, SPAN), 3)]
MIX = np.uint64(0x9E3779B97F4A7C15)


def worst_of(per: np.ndarray, text: np.ndarray, n_texts: int, least: float = -1.0) -> np.ndarray:
    """The WORST highest of the sentences' marks `per` for each text; `least` where there is none."""
    order = np.lexsort((-per, text))
    text = text[order]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    out = np.full((n_texts, WORST), least)
    top = place < WORST
    out[text[top], place[top]] = per[order][top]
    return out


def pieces(word: str) -> list[str]:
    """The windows of a word: itself, and without what separates its letters; long ones as overlapping pieces."""
    word = word.strip(EDGES)
    if len(word) <= LONGEST and word.isalnum():
        return [word]
    return [w[i : i + LONGEST] for w in {word, INSIDE.sub("", word)} - {"", BREAK} for i in range(0, max(1, len(w) - SPAN), LONGEST - SPAN)]


@dataclass
class Sentences:
    """Some texts' sentences: word `at[i]` of `words` is in sentence `sentence[i]`, which is in text `text[sentence[i]]`.

    A word here is a raw word, two neighbours joined, or a run of single characters; `pieces` gives its windows.
    """

    words: list[str]
    at: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    n_texts: int

    def windows(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(windows, number of the window, its sentence) with a row for each window of each sentence."""
        units: dict[str, int] = {}
        flat, ends = array("i"), array("q", [0])
        for w in self.words:
            flat.extend([units.setdefault(x, len(units)) for x in pieces(w)])
            ends.append(len(flat))
        first, each = np.array(ends[:-1]), np.diff(np.array(ends))
        reps = each[self.at]
        unit = np.array(flat, np.int32)[np.repeat(first[self.at] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
        return [*units], unit, np.repeat(self.sentence.astype(np.int32), reps)


def sentences_of(texts: pa.Array) -> Sentences:
    """The sentences of texts: words up to one that ends with a full stop, question or exclamation mark, or to a new line."""
    low = pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), "\n", f" {BREAK} ")
    split = pc.utf8_split_whitespace(low)
    coded = split.flatten().dictionary_encode()
    raw, at = coded.dictionary, coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    word = pc.utf8_trim(raw, EDGES + BREAK)
    size = pc.utf8_length(word).to_numpy()[at]
    closes = pc.match_substring_regex(raw, f"[.!?{BREAK}]$").to_numpy(zero_copy_only=False)[at]
    starts = np.r_[True, closes[:-1] | (text[1:] != text[:-1])][: len(at)]
    sentence = np.cumsum(starts) - 1
    # Neighbours of which one is short.
    near = np.flatnonzero((sentence[1:] == sentence[:-1]) & (size[1:] > 0) & (size[:-1] > 0) & (size[1:] + size[:-1] <= BOTH) & (np.minimum(size[1:], size[:-1]) <= SHORTER))
    pair = pc.binary_join_element_wise(word.take(pa.array(at[near])), word.take(pa.array(at[near + 1])), "").dictionary_encode()
    # Runs of four or more single characters.
    single = np.r_[False, size == 1, False]
    runs = [(lo, hi) for lo, hi in zip(np.flatnonzero(single[1:] & ~single[:-1]), np.flatnonzero(~single[1:] & single[:-1])) if hi - lo > 3]
    words = raw.to_pylist() + pair.dictionary.to_pylist()
    joined = ["".join(word.take(pa.array(at[lo:hi])).to_pylist()) for lo, hi in runs]
    numbers = [at, len(raw) + pair.indices.to_numpy(), len(words) + np.arange(len(runs))]
    where = [sentence, sentence[near], sentence[np.array([lo for lo, _ in runs], np.int64)]]
    return Sentences(words + joined, np.concatenate(numbers), np.concatenate(where), text[starts], len(texts))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, weight), rows by word, summed over occurrences, each word scaled to norm 1."""
    gap = "\0" * SPAN
    text = gap.join(f"\1{w}\2" for w in words) + gap
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2 + SPAN)
    keys, weights = [], []
    for a, b, c in OFFSETS:
        n = len(letters) - c
        parts = letters[:n], letters[a : n + a], letters[b : n + b], letters[c:]
        at = np.flatnonzero((parts[0] > 0) & (parts[1] > 0) & (parts[2] > 0) & (parts[3] > 0))
        code = parts[0][at]
        for x in parts[1:]:
            code = (code * MIX ^ x[at]) * MIX
        keys.append(row[at] * CODES + (code >> np.uint64(44)).astype(np.int64))
        weights.append(np.full(len(at), DECAY ** (c + 1)))
    kinds, where = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(where, np.concatenate(weights), len(kinds))
    r = kinds // CODES
    norm = np.sqrt(np.bincount(r, weight**2, len(words)))
    return r, kinds % CODES, weight / norm[r]


def kernel(words: list[str], landmarks: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Kernel of words against landmarks; landmarks: (known codes + 1, m), columns: code to its row or to the last."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for lo in range(0, len(words), 300):
        r, c, w = subsequences(words[lo : lo + 300])
        if len(r):
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[lo + r[first]] = np.add.reduceat(landmarks[columns[c]] * w[:, None].astype(np.float32), first)
    return out


@dataclass
class Model:
    weights: np.ndarray  # by subsequence code
    bias: float = 0.0
    threshold: float = 0.0
    scale: float = 0.0
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            r, c, w = subsequences(part)
            out[lo : lo + len(part)] += np.bincount(r, w * self.weights[c], len(part))
        return out

    def worst(self, found: Sentences) -> np.ndarray:
        """Mean mark of the worst sentences of each text; a missing one counts as the lower margin."""
        marks = [*map(self.memo.get, found.words)]
        fresh = [i for i, m in enumerate(marks) if m is None]
        own = [pieces(found.words[i]) for i in fresh]
        windows = [*{w for x in own for w in x}]
        known = dict(zip(windows, np.maximum(self.decide(windows), -1.0).tolist()))
        for i, x in zip(fresh, own):
            marks[i] = self.memo[found.words[i]] = known[x[0]] if len(x) == 1 else max((known[w] for w in x), default=-1.0)
        if len(self.memo) > MEMO:  # the older half goes
            self.memo = dict(islice(self.memo.items(), len(self.memo) // 2, None))
        per = np.full(len(found.text), -1.0)
        np.maximum.at(per, found.sentence, np.array(marks, float)[found.at])
        return worst_of(per, found.text, found.n_texts).mean(1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.scale == 0:
            return np.zeros(len(texts))
        return squash(self.worst(sentences_of(texts)), self.threshold, self.scale)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge by Newton steps over the rows inside the margin; y is -1 or 1."""
    x1 = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x1.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        a, c = x1[inside], weight[inside]
        fresh = np.linalg.solve((a * c[:, None]).T @ a + np.diag(penalty), a.T @ (c * y[inside]))
        if np.abs(fresh - w).max() < 1e-6:
            break
        w = fresh
    return w[:-1], float(w[-1])


def learn(toxic: Sentences, clean: Sentences, landmarks: int, rounds: int, most_windows: int, told: int, ratio: float, seed: int) -> Model | None:
    """The machine from the sentences of toxic and of clean texts; None if there is nothing to tell them by."""

    def in_texts(units: list[str], unit: np.ndarray, text: np.ndarray) -> dict[str, int]:
        seen = np.unique(text.astype(np.int64) * len(units) + unit) % max(1, len(units))
        return dict(zip(units, np.bincount(seen, minlength=len(units)).tolist()))

    units, unit, sentence = clean.windows()
    in_clean = in_texts(units, unit, clean.text[sentence])
    del units, unit, sentence
    clean.words = []
    toxic_units, toxic_unit, toxic_sentence = toxic.windows()
    toxic.words = []
    toxic_text = toxic.text[toxic_sentence]
    in_toxic = in_texts(toxic_units, toxic_unit, toxic_text)
    every = sorted((w for w in in_clean if len(w) > 2), key=lambda w: (-in_clean[w], w))
    often = lambda w: in_toxic[w] / toxic.n_texts > ratio * in_clean.get(w, 0) / clean.n_texts
    suspect = sorted((w for w in in_toxic if len(w) > 2 and often(w)), key=lambda w: (-in_toxic[w], w))
    if not suspect or not every:
        return None
    sure = [w for w in suspect if in_toxic[w] >= told] or suspect[:WORST]
    barred = {*suspect}
    every = [w for w in every if w not in barred] or every
    draw = np.random.default_rng(seed)
    rare = every[most_windows // 3 :]
    negative = every[: most_windows // 3] + [rare[i] for i in np.sort(draw.permutation(len(rare))[: 2 * most_windows // 3])]
    some = [negative[i] for i in np.sort(draw.permutation(len(negative))[: landmarks // 2])]
    chosen = list(dict.fromkeys(sure[: landmarks // 2] + some))
    r, c, w = subsequences(chosen)
    known = np.unique(c)
    columns = np.full(CODES, len(known))
    columns[known] = np.arange(len(known))
    table = np.zeros((len(known) + 1, len(chosen)), np.float32)
    table[columns[c], r] = w
    values, vectors = np.linalg.eigh(table.T.astype(float) @ table)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    embed = lambda windows: kernel(windows, table, columns) @ root
    positive, x_pos, x_neg = Counter({w: in_toxic[w] for w in sure}), embed(sure), embed(negative)
    for turn in range(rounds):
        y = np.r_[np.ones(len(x_pos)), -np.ones(len(x_neg))]
        shares = np.sqrt([positive[w] for w in positive]), np.sqrt([in_clean[w] for w in negative])
        weight = np.concatenate([s / s.sum() for s in shares]) * len(y) / 2
        beta, bias = svm(np.r_[x_pos, x_neg], y, weight, ridge=0.3)
        weights = np.zeros(CODES, np.float32)
        weights[known] = table[:-1] @ (root @ beta)
        model = Model(weights, bias)
        if turn == rounds - 1:
            break
        marks, taken = model.decide(every), set(negative)
        hard = [every[i] for i in np.argsort(-marks, kind="stable")[: most_windows // 3] if marks[i] > -0.5 and every[i] not in taken]
        negative, x_neg = negative + hard, np.r_[x_neg, embed(hard)] if hard else x_neg
        # The worst sentences of toxic documents that have no positive one yet, each at its worst window.
        marks = dict(zip(suspect, model.decide(suspect)))
        mark = np.array([marks.get(u, -1.0) for u in toxic_units])
        done = np.zeros(toxic.n_texts, bool)
        done[toxic_text[np.array([u in positive for u in toxic_units])[toxic_unit]]] = True
        bad = np.flatnonzero((mark[toxic_unit] > 0) & ~done[toxic_text])
        bad = bad[np.lexsort((toxic_unit[bad], -mark[toxic_unit[bad]], toxic_sentence[bad]))]
        bad = bad[np.r_[True, toxic_sentence[bad][1:] != toxic_sentence[bad][:-1]][: len(bad)]]  # of each sentence its worst window
        bad = bad[np.lexsort((toxic_unit[bad], -mark[toxic_unit[bad]], toxic_text[bad]))]
        bad = bad[np.arange(len(bad)) - np.searchsorted(toxic_text[bad], toxic_text[bad]) < WORST]  # of each text its worst sentences
        fresh = Counter(toxic_units[u] for u in toxic_unit[bad].tolist())
        if fresh:
            positive, x_pos = positive + fresh, np.r_[x_pos, embed(list(fresh))]
    model.memo = {}
    return model


def fit(rows: list[tuple[str, int]], landmarks: int = 512, rounds: int = 5, most_windows: int = 9000, told: int = 6, ratio: float = 20, seed: int = 11, more_clean: Callable[[Model], np.ndarray] | None = None) -> Model:
    """Train on (text, label) rows; the module's docstring says how. `more_clean` gives marks of further clean texts."""
    texts, labels = pa.array([t for t, _ in rows], pa.string()), np.array([y for _, y in rows], int)
    part = lambda keep: sentences_of(texts.filter(pa.array(keep)))
    nothing, every = Model(np.zeros(CODES, np.float32)), np.ones(len(rows), bool)

    def machine(keep: np.ndarray) -> Model | None:
        if not ((labels == 1) & keep).any() or not ((labels == 0) & keep).any():
            return None
        return learn(part((labels == 1) & keep), part((labels == 0) & keep), landmarks, rounds, most_windows, told, ratio, seed)

    model = machine(every)
    if model is None:
        return nothing
    kept_out = np.arange(len(rows)) % CALIBRATION == 0
    judge, judged = machine(~kept_out), kept_out
    if judge is None or len(np.unique(labels[kept_out])) < 2:
        judge, judged = model, every
    bad, good = judge.worst(part(judged & (labels == 1))), judge.worst(part(judged & (labels == 0)))
    if more_clean is not None:
        judge.memo = {}
        good = np.r_[good, more_clean(judge)]
    at = np.unique(np.r_[bad, good])
    cuts = np.r_[at[0] - 1e-6, (at[1:] + at[:-1]) / 2, at[-1] + 1e-6]
    right = np.array([TOXIC_WEIGHT * np.mean(bad >= c) + (1 - TOXIC_WEIGHT) * np.mean(good < c) for c in cuts])
    model.threshold = float(cuts[np.isclose(right, right.max())].mean())
    model.scale = 6.0 / max(1e-3, float(np.mean(bad) - np.mean(good)))
    model.memo = {}
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = 1200, clean_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample. Up to `clean_rows` further clean texts are marked where they lie, for the threshold."""
    ship(docs.sparkSession)

    def more_clean(judge: Model) -> np.ndarray:
        @F.arrow_udf(T.DoubleType())
        def mark(texts: pa.Array) -> pa.Array:
            parts = [judge.worst(sentences_of(texts[lo:hi])) for lo, hi in byte_chunks(texts, 2_000_000)]
            return pa.array(np.concatenate(parts) if parts else [], pa.float64())

        known = labels.where(usable & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
        chosen = known.where("y = 0").orderBy(F.xxhash64("id"), "id").offset(per_class).limit(clean_rows).select("id")
        met = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
        rows = met.groupBy("id").agg(F.min("t").alias("t")).select("id", mark("t").alias("mark")).orderBy("id").collect()
        return np.array([r.mark for r in rows], float)

    return fit(labelled_sample(docs, labels, label, usable, per_class), more_clean=more_clean)


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.scores(texts[lo:hi]) for lo, hi in byte_chunks(texts, 2_000_000)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
