"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Method: labelled tokens train a two-state CRF whose emissions are hashed word and prefix
features; its forward-backward marginals tag the tokens of every document.  A document's
score is a logistic function of its marginals (their sum, density and maximum), and its
spans are the character offsets of runs of tokens with a marginal of one half or more.

The labels at hand are per document.  A token of a toxic training document counts as
labelled toxic when its word, or one of its prefixes, is markedly more frequent in toxic
documents than in clean ones; every other token counts as labelled clean.

The CRF is fitted on a bounded sample, at most ``TRAIN_CLEAN`` and ``TRAIN_TOXIC``
documents of at most ``TRAIN_CHARS`` characters drawn by a hash of the id, near copies of each other thinned out.  The class balance is counted over
all labels, and every document is scored over its whole text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, words_of

#: Bounds of the training sample: documents of each class.
TRAIN_CLEAN, TRAIN_TOXIC = 3000, 1000
#: Longer texts are scored like any other, but not drawn for the training sample.
TRAIN_CHARS = 200_000
BITS = 18
PREFIXES = range(4, 9)
ROUNDS = 30
#: A feature marks tokens as toxic at this ratio of rates and this likelihood ratio (G).
RATIO, EVIDENCE = 4.0, 24.0
#: Texts are tagged in chunks of about this many characters.
CHUNK = 2_000_000
CACHE = 300_000

WORD = re.compile(r"[^\W\d_]+")
RESULT = "score double, predicted int, spans array<struct<start:int,end:int,p:double>>"


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets hold: letters that grow stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def lines_of_words(text: str) -> list[list[str]]:
    return [WORD.findall(line) for line in lowered(text).split("\n")]


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def slots(word: str) -> list[int]:
    """Hashed feature slots of a word; slot 0 is the bias."""
    mask = (1 << BITS) - 1
    return [0, *((xxhash.xxh32_intdigest(f) & mask) or 1 for f in features(word))]


@dataclass
class Chains:
    """Token chains laid out by time step, longest first, for vectorised passes."""

    order: list[np.ndarray]  # for each step, the positions of the chains still running

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chains:
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        by_length = np.argsort(-lengths, kind="stable")
        starts, sorted_lengths = starts[by_length].astype(np.int32), lengths[by_length]
        alive = np.searchsorted(-sorted_lengths, -np.arange(lengths.max(initial=0)), side="left")
        return cls([starts[:n] + np.int32(t) for t, n in enumerate(alive)])

    def odds(self, emission: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward odds, backward odds and the tokens' own odds of the toxic state."""
        start, t01, t10, t11 = np.exp(edge).astype(emission.dtype)
        own = np.exp(np.clip(emission, -15, 15))
        ahead, behind = np.empty_like(own), np.ones_like(own)
        for t, at in enumerate(self.order):
            if t == 0:
                ahead[at] = own[at] * start
            else:
                r = ahead[at - 1]
                ahead[at] = own[at] * (t01 + t11 * r) / (1 + t10 * r)
        for at in reversed(self.order[1:]):
            w = own[at] * behind[at]
            behind[at - 1] = (t10 + t11 * w) / (1 + t01 * w)
        return ahead, behind, own


def marginals(chains: Chains, emission: np.ndarray, edge: np.ndarray) -> np.ndarray:
    ahead, behind, _ = chains.odds(emission, edge)
    both = ahead * behind
    return both / (1 + both)


def marks(texts: list[list[list[str]]], toxic: np.ndarray) -> set[str]:
    """Features that are markedly more frequent in toxic documents than in clean ones."""
    counts = (Counter(), Counter())
    # toxic documents first: features that none of them has need no count
    for y, lines in sorted(zip(toxic.tolist(), texts, strict=True), key=lambda x: -x[0]):
        found = {f for w in {w for line in lines for w in line} for f in features(w)}
        counts[int(y)].update(found if y else found & counts[1].keys())
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    found = set()
    for f, t in counts[1].items():
        c = counts[0][f]
        if t * n0 >= RATIO * c * n1:
            share = (t + c) / (n1 + n0)
            g = 2 * (t * np.log(t / (share * n1)) + (c * np.log(c / (share * n0)) if c else 0))
            if g >= EVIDENCE:
                found.add(f)
    return found


@dataclass
class Tagger:
    """A fitted CRF with the logistic function that turns marginals into a score."""

    weights: np.ndarray
    edge: np.ndarray
    scale: np.ndarray

    def emission(self, word: str) -> float:
        return float(self.weights[slots(word)].sum())

    def evidence(self, p: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """Columns for each of ``n`` documents: one, sum, density and maximum of marginals."""
        total = np.bincount(docs, p, n)
        tokens = np.maximum(np.bincount(docs, minlength=n), 1)
        most = np.zeros(n)
        np.maximum.at(most, docs, p)
        return np.column_stack([np.ones(n), np.log1p(total), np.log(total / tokens + 1e-4), most])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.scale, -30, 30)))


def fit_crf(texts: list[list[list[str]]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and edge parameters by gradient ascent on the chains' likelihood."""
    found = marks(texts, toxic)
    vocabulary: dict[str, int] = {}
    tokens, lengths, in_toxic = array("i"), array("i"), array("b")
    for lines, y in zip(texts, toxic, strict=True):
        for line in lines:
            tokens.extend(vocabulary.setdefault(w, len(vocabulary)) for w in line)
            lengths.append(len(line))
            in_toxic.append(int(y))
    marked = np.array([any(f in found for f in features(w)) for w in vocabulary], bool)
    wide = max((len(slots(w)) for w in vocabulary), default=1)
    pad = 1 << BITS
    slot = np.full((len(vocabulary), wide), pad)
    for k, w in enumerate(vocabulary):
        own = slots(w)
        slot[k, : len(own)] = own
    token, length = np.array(tokens, np.int32), np.array(lengths, np.int64)
    y = np.repeat(np.array(in_toxic, bool), length) & marked[token] if len(token) else np.zeros(0, bool)
    chains = Chains.of(length[length > 0])
    ends = np.cumsum(length[length > 0])
    first = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    linked = np.ones(len(token), bool)
    linked[first] = False
    right = np.flatnonzero(linked).astype(np.int32)
    left = right - 1
    seen = np.array(
        [y[first].sum(), (~y[left] & y[right]).sum(), (y[left] & ~y[right]).sum(), (y[left] & y[right]).sum()], float
    )
    weights, edge = np.zeros(pad + 1), np.zeros(4)
    weights[0] = -4.0
    m, v, me, ve = np.zeros_like(weights), np.zeros_like(weights), np.zeros(4), np.zeros(4)
    for k in range(1, ROUNDS + 1):
        ahead, behind, own = chains.odds(weights[slot].sum(1).astype(np.float32)[token], edge)
        both = ahead * behind
        p = both / (1 + both)
        g = np.bincount(
            slot.ravel(), np.repeat(np.bincount(token, y - p, len(vocabulary)), wide), minlength=pad + 1
        )
        g -= 0.05 * weights
        g[pad] = 0
        _, t01, t10, t11 = np.exp(edge).astype(np.float32)
        w, r = own[right] * behind[right], ahead[left]
        m01, m10, m11 = t01 * w, t10 * r, t11 * r * w
        z = 1 + m01 + m10 + m11
        total = lambda x: x.sum(dtype=np.float64)
        ge = seen - np.array([total(p[first]), total(m01 / z), total(m10 / z), total(m11 / z)]) - 0.05 * edge
        for x, d, m1, v1 in ((weights, g, m, v), (edge, ge, me, ve)):
            m1 += 0.1 * (d - m1)
            v1 += 0.03 * (d * d - v1)
            x += 0.4 * (m1 / (1 - 0.9**k)) / (np.sqrt(v1 / (1 - 0.97**k)) + 1e-3)
    return weights[:-1], edge


def flat(texts: list[list[list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All words, the chain lengths, and the document of each word."""
    words = [w for lines in texts for line in lines for w in line]
    lengths = np.array([len(line) for lines in texts for line in lines if line], np.int64)
    docs = np.repeat(np.arange(len(texts)), [sum(map(len, lines)) for lines in texts])
    return words, lengths, docs


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        b += np.linalg.solve(h, x.T @ (y - p) - 0.1 * b)
    return b


def fit(texts: list[str], toxic: list[int], prior: float) -> Tagger:
    """Fits the CRF on two thirds of the texts and the score on the others.

    ``prior`` is the share of toxic documents among all labels, which the sample's may not be.
    """
    y = np.array(toxic, int)
    pool: dict[str, str] = {}  # one object for each distinct word keeps the driver small
    split = [[[pool.setdefault(w, w) for w in line] for line in lines_of_words(t)] for t in texts]
    hold = np.arange(len(y)) % 3 == 0
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Tagger(np.zeros(1 << BITS), np.zeros(4), np.array([odds, 0, 0, 0]))
    weights, edge = fit_crf([t for t, h in zip(split, hold, strict=True) if not h], y[~hold])
    tagger = Tagger(weights.astype(np.float32), edge, np.zeros(4))
    held = [t for t, h in zip(split, hold, strict=True) if h]
    words, lengths, docs = flat(held)
    p = marginals(Chains.of(lengths), np.array([tagger.emission(w) for w in words]), edge)
    tagger.scale = logistic(tagger.evidence(p, docs, len(held)), y[hold])
    share = y[hold].mean()
    tagger.scale[0] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(share / (1 - share))
    return tagger


def training_fold(id_col: str) -> Column:
    """True for ids whose labels may be learnt from: crc32 of the id's text mod 5 is not 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fits a tagger on a bounded, hash-drawn sample of the labelled training fold.

    Null labels are ignored; of several labels of an id the largest counts.  Without
    documents of both classes the score is the share of toxic labels.
    """
    own = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & training_fold(id_col))
        .groupBy(F.col(id_col).alias("__i"))
        .agg((F.max("toxic") > 0).cast("int").alias("__y"))
    )
    n, ones = own.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0))).first()
    most = (TRAIN_CLEAN, TRAIN_TOXIC)
    drawn = [own.where(F.col("__y") == y).orderBy(F.xxhash64("__i")).limit(2 * most[y]) for y in (0, 1)]
    words = words_of(F.col("__t"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda i: F.xxhash64(F.get("__w", i - 1), F.get("__w", i)))
    sample = (
        docs.select(F.col(id_col).alias("__i"), text_or_empty(text_col).alias("__t"))
        .where(F.length("__t") <= TRAIN_CHARS)
        .join(F.broadcast(drawn[0].union(drawn[1])), "__i")
        .withColumn("__w", words)
        # near copies mostly agree in their smallest word pair: one of them is enough
        .withColumn("__s", F.when(F.size("__w") > 1, F.array_min(pairs)).otherwise(F.xxhash64("__t")))
        .groupBy("__y", "__s")
        .agg(F.min(F.struct(F.xxhash64("__i").alias("k"), F.col("__t").alias("t"))).alias("d"))
        .select("__y", "d.k", "d.t")
    )
    # an id may have any number of texts: the bound holds for rows
    rows = pd.concat([sample.where(F.col("__y") == y).orderBy("k", "t").limit(most[y]).toPandas() for y in (0, 1)])
    return fit(rows["t"].tolist(), rows["__y"].tolist(), ones / n if n else 0.0)


def spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, mean marginal) of each run of tokens of a line with p of a half or more."""
    found: list[tuple[int, int, float]] = []
    run: list[tuple[int, int, float]] = []
    at, k = 0, 0

    def close() -> None:
        if run:
            found.append((run[0][0], run[-1][1], float(np.mean([x[2] for x in run]))))
            run.clear()

    for line in text.split("\n"):
        for m in WORD.finditer(line):
            if p[k] >= 0.5:
                run.append((at + m.start(), at + m.end(), p[k]))
            else:
                close()
            k += 1
        close()
        at += len(line) + 1
    return found


def verdicts(text: Column, tagger: Tagger) -> Column:
    """A struct of score, predicted and spans for each text; a null text is an empty one."""

    @F.pandas_udf(RESULT)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}

        def of(words: list[str]) -> np.ndarray:
            if len(known) > CACHE:
                known.clear()
            for w in set(words).difference(known):
                known[w] = tagger.emission(w)
            return np.fromiter(map(known.__getitem__, words), float, len(words))

        for batch in batches:
            texts, out, k = batch.tolist(), [], 0
            while k < len(texts):
                first, size = k, 0
                while k < len(texts) and (k == first or size < CHUNK):
                    size += len(texts[k])
                    k += 1
                own = texts[first:k]
                words, lengths, docs = flat([lines_of_words(t) for t in own])
                p = marginals(Chains.of(lengths), of(words), tagger.edge)
                score = tagger.score(tagger.evidence(p, docs, len(own)))
                ends = np.cumsum(np.bincount(docs, minlength=len(own)))
                hot = np.zeros(len(own), bool)
                hot[docs[p >= 0.5]] = True
                for j, t in enumerate(own):
                    part = p[ends[j - 1] if j else 0 : ends[j]]
                    out.append((float(score[j]), int(score[j] >= 0.5), spans(lowered(t), part) if hot[j] else []))
            yield pd.DataFrame(out, columns=["score", "predicted", "spans"])

    return tag(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, spans) for every row of ``docs``.

    Empty and null texts get the score of a text without words.  Null ids count as not
    held out.  Repeated rows give repeated results; an empty table an empty result.
    """
    return docs.select(
        F.col(id_col), (~training_fold(id_col)).alias("held_out"), verdicts(F.col(text_col), tagger).alias("__v")
    ).select(id_col, "held_out", "__v.*")


def keep_clean(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the tagger does not call toxic, columns unchanged."""
    return docs.withColumn("__v", verdicts(F.col(text_col), tagger)).where("__v.predicted = 0").drop("__v")
