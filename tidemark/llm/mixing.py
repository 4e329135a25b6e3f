"""Mixing to target weights: soft domain membership, and document rates by least squares.

Method: a labelled table trains a naive Bayes classifier over hashed words; it gives every
document a posterior over domains.  Nonnegative document rates are then fitted by
distributed projected gradient steps so that the expected tokens of each domain,
``sum(rate * tokens * posterior)``, match the targets.

With A = tokens * posterior, the objective is the least-squares misfit weighted by the
inverse of ``M = sum(tokens * posterior * posterior')`` over documents with a positive
rate, and steps are scaled by 1 / tokens, so that targets are met in a few steps.  A step
that makes the misfit larger is taken back and halved.

Scale: training reads a bounded sample of labelled documents (``TRAIN_DOCS``).  Posteriors
come from one projection, no shuffle.  Each gradient step is one scan of the narrow table
of posteriors that ends in one row of K sums; the driver sees K numbers a step and a
document's rate is an expression of them.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, words_of, written

#: Buckets of hashed words.
BUCKETS = 8192
#: Log likelihood ratios are divided by this before they become posteriors.
TEMPER = 3.0
#: Bound of the training sample, drawn by a hash of the id.
TRAIN_DOCS = 12_000
MAX_DOMAINS = 32
STEPS = 30
#: Steps end when the misfit is below this share of all target tokens.
ENOUGH = 1e-9
TARGETS = {"high": 0.9, "low": 0.08, "toxic": 0.02}


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of quality and toxic marks; null marks count as 0."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "high").otherwise("low")
    return labels.select("doc_id", domain.alias("domain"))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, domains: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, list[float]]:
    """For each domain the log prior, then the log likelihood of each bucket.

    Null ids and domains are ignored, of several domains of an id the smallest counts.
    Priors are counted over all labels; word counts over the sample.
    """
    own = domains.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).groupBy(F.col(id_col).alias("__i")).agg(F.min("domain").alias("domain"))
    prior = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count("*").alias("n")).limit(MAX_DOMAINS + 1).collect()}
    if len(prior) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    sample = own.orderBy(F.xxhash64("__i"), "__i").limit(TRAIN_DOCS)
    # a word counts once in a document
    words = F.array_distinct(F.transform(words_of(text_or_empty(text_col)), bucket))
    counts = (
        docs.select(F.col(id_col).alias("__i"), F.col(text_col))
        .join(F.broadcast(sample), "__i")
        .select("domain", F.explode(words).alias("b"))
        .groupBy("domain", "b")
        .count()
        .collect()  # at most MAX_DOMAINS * BUCKETS rows
    )
    seen = {d: [1.0] * BUCKETS for d in sorted(prior)}
    for r in counts:
        seen[r["domain"]][r["b"]] += r["count"]
    total = sum(prior.values())
    return {
        d: [math.log(prior[d] / total), *(math.log(c / sum(n)) for c in n)] for d, n in seen.items()
    }


def membership(docs: DataFrame, model: dict[str, list[float]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tokens`` and the posterior array ``__p`` over the sorted domains.

    Log likelihoods are summed over a document's distinct buckets and tempered, which
    keeps memberships soft.  Texts without words get the priors.
    """
    names = sorted(model)
    # literals, folded into one array each; relative to the first domain
    tables = [
        F.split(F.lit(" ".join(f"{model[d][b + 1] - model[names[0]][b + 1]:.5f}" for b in range(BUCKETS))), " ").cast("array<double>")
        for d in names
    ]
    zero = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(len(names))])
    sums = F.aggregate(
        "__b",
        zero,
        lambda a, b: F.struct(*[(a[f"s{k}"] + F.get(tables[k], b)).alias(f"s{k}") for k in range(len(names))]),
    )
    logits = F.array(*[F.col(f"__s.s{k}") / TEMPER + F.lit(model[d][0]) for k, d in enumerate(names)])
    return (
        docs.withColumn("__w", F.transform(words_of(text_or_empty(text_col)), bucket))
        .withColumn("__tokens", F.size("__w").cast("long"))
        .withColumn("__b", F.array_distinct("__w"))
        .withColumn("__s", sums)
        .withColumn("__l", logits)
        .withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
        .withColumn("__p", F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, y: a + y)))
        .drop("__w", "__b", "__s", "__l", "__e")
    )


def solve(m: list[list[float]], b: list[float]) -> list[float]:
    """Solves a small system by elimination; a ridge keeps absent domains harmless."""
    n = len(b)
    ridge = 1e-9 * max(1.0, sum(m[k][k] for k in range(n)))
    rows = [[m[j][k] + ridge * (j == k) for k in range(n)] + [b[j]] for j in range(n)]
    for j in range(n):
        best = max(range(j, n), key=lambda r: abs(rows[r][j]))
        rows[j], rows[best] = rows[best], rows[j]
        for r in range(n):
            if r != j:
                f = rows[r][j] / rows[j][j]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[j], strict=True)]
    return [rows[j][n] / rows[j][j] for j in range(n)]


def rates(table: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None) -> tuple[Column, list[float]]:
    """The fitted rate as an expression of ``__p`` and ``__tokens``, and the last misfits.

    ``budget`` is the total of expected tokens, by default all that there are.  Targets are
    scaled to one; domains without a target get none, unknown domains are an error.
    """
    if unknown := set(targets) - set(names):
        raise ValueError(f"targets for unknown domains: {sorted(unknown)}")
    k = len(names)
    p = [F.get("__p", F.lit(j)) for j in range(k)]
    t = F.col("__tokens").cast("double")
    tokens = float(table.agg(F.coalesce(F.sum("__tokens"), F.lit(0))).first()[0])
    total = tokens if budget is None else budget
    share = sum(targets.get(d, 0.0) for d in names)
    goal = [total * targets.get(d, 0.0) / share for d in names]
    rate: Column = F.lit(total / tokens if tokens else 0.0)
    best, misfit, least, size = rate, [0.0] * k, math.inf, 1.0
    y = [0.0] * k
    for _ in range(STEPS if tokens else 0):
        on = F.when(rate > 0, t).otherwise(0.0)
        now = table.agg(
            *[F.sum(rate * t * p[j]).alias(f"a{j}") for j in range(k)],
            *[F.sum(on * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)],
        ).first()
        off = [now[f"a{j}"] - goal[j] for j in range(k)]
        if (norm := math.fsum(x * x for x in off)) < least:
            best, misfit, least, size = rate, off, norm, 1.0
            if max(map(abs, off)) <= ENOUGH * total:
                break
            y = solve([[now[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], off)
        else:
            size /= 2
        move = [size * v for v in y]
        rate = F.greatest(F.lit(0.0), best - sum((F.lit(move[j]) * p[j] for j in range(1, k)), F.lit(move[0]) * p[0]))
    return best, misfit


def mix(
    docs: DataFrame,
    domains: DataFrame,
    targets: dict[str, float] | None = None,
    budget: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep, tokens, domain, posterior, rate, misfit): one row for each row of ``docs``.

    ``posterior`` maps domains to probabilities, ``domain`` is the likeliest (ties: the
    first by name), ``rate`` the expected number of times that the document is taken, zero
    or more.  Null and empty texts have no tokens and the prior as posterior; repeated rows
    are fitted one by one.  Without any label the rate is the same for all documents.
    ``misfit`` is the largest share of all tokens by which a domain misses its target, the
    same in all rows: targets that cannot be met show there.  ``targets`` for domains that
    no label has are an error; of the default ones they are left out.  ``keep`` names more
    columns of ``docs`` to pass through, other than those made here.
    """
    model = train(docs, domains, id_col, text_col) or {"all": [0.0] * (BUCKETS + 1)}
    names = sorted(model)
    wanted = targets if targets and names != ["all"] else {d: w for d, w in TARGETS.items() if d in model} or {d: 1.0 for d in names}
    kept = [c for c in keep if c not in (id_col, "tokens", "domain", "posterior", "rate", "misfit")]
    own = docs.select(id_col, *{text_col: 0, **dict.fromkeys(kept)})
    table = written(membership(own, model, text_col).select(id_col, *kept, "__tokens", "__p"), "posteriors")
    rate, misfit = rates(table, names, wanted, budget)
    total = table.agg(F.sum("__tokens")).first()[0] if budget is None else budget
    best = F.get(F.array(*[F.lit(d) for d in names]), (F.array_position("__p", F.array_max("__p")) - 1).cast("int"))
    return table.select(
        id_col,
        *kept,
        F.col("__tokens").alias("tokens"),
        best.alias("domain"),
        F.map_from_arrays(F.array(*[F.lit(d) for d in names]), "__p").alias("posterior"),
        rate.alias("rate"),
        F.lit(max(map(abs, misfit)) / total if total else 0.0).alias("misfit"),
    )
