"""Quality classifier from weak labels: expectation-maximisation, then a hashed linear scorer.

Method: overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation over all votes estimates the share of good documents and each
labeller's accuracies (how it votes on good and on bad documents), without any true
label.  The posteriors are soft labels of a bounded sample of documents, on which a
logistic regression over hashed word, word-shape and repetition features is trained; it scores the
whole text of every document.

Scale: votes take one scan; only counts of vote patterns reach the driver, at most
3 ** labellers of them whatever the input.  Training takes at most ``TRAIN_DOCS``
documents for each side, drawn by a hash of id and text; their features are made in tasks,
so the driver gets at most 2 ** ``BITS`` numbers for each.  Scoring is one scan.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, written

#: Bound of the training sample, for posteriors of a half or more and for others.
TRAIN_DOCS = 1200
BITS = 17
EM_ROUNDS = 200
EPOCHS = 30
CACHE = 300_000
#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    "a and are as at be by for from he in is it of on or that the this to was were with "
    "der die das und ein eine ist nicht mit auf den von zu im sich des für als auch es dem "
    "le la les et un une de du est que qui en dans pour pas sur au par avec il elle "
    "el los las y del se una por con su al lo como más pero sus".split()
)
LABELLERS = ("length", "letters", "symbols", "capitals", "stop_words", "variety", "lines", "word_length", "stutter")
#: Character classes of code points below 0x250: letter, capital, digit, space, symbol.
CLASSES = np.array(
    [
        (1 if chr(c).isupper() else 0 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if chr(c).isspace() else 5 if chr(c) in ".,;:!?'\"-()" else 4)
        for c in range(0x250)
    ],
    np.uint8,
)


def stutter(words: list[str]) -> float:
    """Share of words that repeat the word before them."""
    return sum(map(str.__eq__, words, words[1:])) / max(1, len(words))


def votes(text: str) -> str:
    """One character for each labeller: "1" good, "0" bad, "-" abstains.

    Every labeller looks at one ratio; it votes where the ratio is clear.
    """
    words = text.split()
    n = len(words)
    if not n:
        return "0" + "-" * (len(LABELLERS) - 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small, capital, _, _, symbol, _ = np.bincount(CLASSES[np.minimum(points, 0x24F)], minlength=6)
    chars = max(1, sum(map(len, words)))
    letters = int(small + capital)
    lines = [s for s in text.split("\n") if s.strip()]

    def side(x: float, good: tuple[float, float], bad_below: float, bad_above: float) -> str:
        return "1" if good[0] <= x <= good[1] else "0" if x < bad_below or x > bad_above else "-"

    stops = sum(map(STOP_WORDS.__contains__, text.lower().split())) / n
    return "".join(
        (
            "0" if n < 4 else "1" if n >= 20 else "-",
            side(letters / chars, (0.85, 1), 0.7, 9),
            side(symbol / n, (0, 0.05), -1, 0.25),
            side(capital / max(1, letters), (0, 0.12), -1, 0.4),
            side(stops, (0.12, 0.75), 0.06, 0.9),
            "-" if n < 40 else side(len(set(words)) / n**0.8, (0.95, 99), 0.75, 999),
            side(1 - len(set(lines)) / max(1, len(lines)), (0, 0.05), -1, 0.3),
            side(chars / n, (3, 9), 2, 14),
            "-" if n < 10 else side(stutter(words), (0, 0.02), -1, 0.15),
        )
    )


@dataclass
class VoteModel:
    """Share of good documents, and each labeller's log odds for its votes."""

    prior: float
    odds: np.ndarray  # labellers x votes (good, bad, abstains)
    accuracy: np.ndarray  # labellers x (on good, on bad): share of right votes among votes

    def posterior(self, pattern: str) -> float:
        x = np.log(self.prior / (1 - self.prior)) + sum(self.odds[k]["10-".index(v)] for k, v in enumerate(pattern))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit_votes(patterns: dict[str, int]) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    Starts from the majority of votes, and smooths towards labellers that are right seven
    times out of eight, which keeps the side called good the one that the votes call good.
    """
    m = len(LABELLERS)
    if not patterns:
        return VoteModel(0.5, np.zeros((m, 3)), np.full((m, 2), 0.5))
    count = np.array(list(patterns.values()), float)
    vote = np.array([["10-".index(v) for v in p] for p in patterns])
    good, bad = (vote == 0).sum(1), (vote == 1).sum(1)
    q = (good + 1) / (good + bad + 2)
    base = np.array([[7.0, 1.0], [1.0, 7.0]])
    prior, rate = 0.5, np.zeros((2, m, 3))
    for _ in range(EM_ROUNDS):
        prior = float(np.clip((q @ count + 1) / (count.sum() + 2), 1e-4, 1 - 1e-4))
        for side, weight in enumerate((q * count, (1 - q) * count)):
            for v in range(2):
                rate[side, :, v] = (weight[:, None] * (vote == v)).sum(0) + base[side, v]
            rate[side, :, :2] /= rate[side, :, :2].sum(1, keepdims=True)
        odds = np.zeros((m, 3))  # abstaining says nothing
        odds[:, :2] = np.log(rate[0, :, :2]) - np.log(rate[1, :, :2])
        x = np.log(prior / (1 - prior)) + odds[np.arange(m), vote].sum(1)
        new = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        moved, q = float(np.abs(new - q).max()), new
        if moved < 1e-9:
            break
    right = np.stack([rate[0, :, 0], rate[1, :, 1]], 1)
    return VoteModel(prior, odds, right)


SHAPES = [(re.compile(p), s) for p, s in ((r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][^\W\d_]*[A-ZÀ-ÖØ-Þ][^\W\d_]*", "AA"), (r"[A-ZÀ-ÖØ-Þ][^\W\d_]*", "Aa"), (r"[^\W\d_]+", "a"), (r"\d+", "0"))]


def shape(word: str) -> str:
    for pattern, by in SHAPES:
        word = pattern.sub(by, word)
    return word[:8]


def slots(word: str) -> list[int]:
    """Hashed features of a word: the word itself, its shape, its length with its shape."""
    s = shape(word)
    names = ("w" + word.lower(), "s" + s, f"l{min(len(word), 20)}{s}")
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


#: Slot of the share of stuttered words.
STUTTER = xxhash.xxh32_intdigest(b"stutter") & ((1 << BITS) - 1)


def counts(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text: mean of its words' features, whole text."""
    if len(known) > CACHE:
        known.clear()
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    seen = Counter(words)
    for w in seen.keys() - known.keys():
        known[w] = slots(w)
    slot = np.array([known[w] for w in seen], np.int64).ravel()
    value = np.repeat(np.array(list(seen.values())) / len(words), 3)
    return np.append(slot, STUTTER), np.append(value, stutter(words))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: list[float]) -> np.ndarray:
    """Weights, the last one the bias: logistic regression on soft targets by Adam.

    ``rows`` has the (slots, values) of each text.
    """
    size = 1 << BITS
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not rows:
        return w
    slot = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array(target)
    for k in range(1, EPOCHS + 1):
        x = np.bincount(doc, w[slot] * value, len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        e = (y - p) / len(rows)
        g = np.append(np.bincount(slot, e[doc] * value, size), e.sum()) - 1e-7 * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w += 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
    return w


def vote_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, votes): the votes on each row's whole text, and the text's hash."""

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return texts.map(votes)

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias(id_col), F.xxhash64(text).alias("h"), vote(text).alias("votes"))


def feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(i, h, votes, slots, values) of (i, h, votes, t), the values of equal slots added up."""
    known: dict[str, list[int]] = {}
    for batch in batches:
        made = []
        for text in batch["t"]:
            slot, value = counts(text, known)
            own, at = np.unique(slot, return_inverse=True)
            made.append((own.astype(np.int32), np.bincount(at, value, len(own))))
        yield batch.drop(columns="t").assign(slots=[m[0] for m in made], values=[m[1] for m in made])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[VoteModel, np.ndarray, DataFrame]:
    """The vote model of all documents, the scorer's weights, and the votes of each row."""
    voted = written(vote_column(docs, id_col, text_col), "votes")
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_votes(patterns)
    good = [p for p in patterns if model.posterior(p) >= 0.5]
    is_good = F.col("votes").isin(good)
    drawn = [
        voted.where(c & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("i"), "h", "votes")
        .distinct()
        .orderBy(F.xxhash64("i", "h"), "i", "h")
        .limit(TRAIN_DOCS)
        for c in (is_good, ~is_good)
    ]
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))
    sample = own.join(F.broadcast(drawn[0].union(drawn[1])), ["i", "h"]).select("i", "h", "votes", "t")
    made = sample.mapInPandas(feature_rows, "i long, h long, votes string, slots array<int>, values array<double>")
    rows = made.dropDuplicates(["i", "h"]).toPandas().sort_values(["i", "h"], kind="stable")  # at most 2 * TRAIN_DOCS
    features = [(np.asarray(s, np.int64), np.asarray(v, float)) for s, v in zip(rows["slots"], rows["values"], strict=True)]
    weights = fit_scorer(features, [model.posterior(p) for p in rows["votes"]])
    return model, weights.astype(np.float32), voted


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted): every row's whole text; 1 is good, from a score of one half on.

    Null and empty texts score zero.  Rows are scored one by one.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        own, repeats = float(weights[-1]), float(weights[STUTTER])

        def weight(word: str) -> float:
            known[word] = x = float(weights[slots(word)].sum())
            return x

        def one(text: str) -> float:
            words = text.split()
            if not words:
                return 0.0
            if len(known) > CACHE:
                known.clear()
            for w in set(words).difference(known):
                weight(w)
            x = sum(map(known.__getitem__, words)) / len(words) + own + stutter(words) * repeats
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        for batch in batches:
            yield batch.map(one).astype(float)

    scored = docs.select(F.col(id_col).alias(id_col), of(text_or_empty(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) from a model trained on the documents themselves.

    An empty table gives an empty result.  Null ids are scored, never trained on.
    """
    _, weights, _ = train(docs, id_col, text_col)
    return score(docs, weights, id_col, text_col)
