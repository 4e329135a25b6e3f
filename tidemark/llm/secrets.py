"""Secret scans: known shapes, and windows of high entropy in candidate strings.

Method: a candidate is a whole run of ``[A-Za-z0-9+/=_-]`` with ``WINDOW`` characters or more.
A window slides over it.  The counts of its characters, of its kinds of characters and the sum
of c * log2(c) over its counts c change by one character out and one in, so Shannon entropy
costs the same for each step; the sum is kept in fixed point, so steps leave no error.  A window
belongs to the narrowest of three character classes that holds it, and each class has an entropy
that it must reach and a mixture of digits and letters that it must have (long words and paths
have none).  Windows that overlap become one span, of the widest class among them.

Spans are suppressed if the candidate is on the allow-list: shapes that are no secrets (UUIDs,
dates), placeholders, ascending sequences, and literal strings that the caller passes.  Spans of
known shapes (``assign``, ``access``, ``hex``) are never suppressed; an entropy span inside one
of them says nothing new and is left out.

Each text is scanned once, by itself, in a pandas function: nothing is shuffled or collected.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Kinds in the order that breaks ties of equal starts.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_alnum", "entropy_base64")
#: Entropy in bits that a window of each class must reach; classes from narrow to wide.
LEAST_BITS = {"entropy_hex": 3.0, "entropy_alnum": 3.7, "entropy_base64": 3.9}

# Shapes of the contract; letters of the first may have either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % WINDOW)
#: Whole candidates that are no secrets: UUIDs, and dates with times.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d\d-\d\d[T_-]?[\d_-]*Z?")
#: Parts of candidates that are placeholders or sequences.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|xxxx|1234567890|0123456789|abcdefgh|(.)\1{7}", re.IGNORECASE | re.ASCII)

UNIT = 1 << 20
#: c * log2(c) in fixed point, for a character's count c in a window.
PART = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1))]
#: A window has enough entropy if its sum of ``PART`` is at most this.
MOST = {kind: math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT) for kind, bits in LEAST_BITS.items()}

#: The kind of each character: digit, lower or upper hex letter, other lower or upper letter, mark.
DIGIT, LOW_HEX, UP_HEX, LOW, UP, MARK = range(6)
CLASS = {
    chr(c): DIGIT if 48 <= c <= 57 else LOW_HEX if 97 <= c <= 102 else UP_HEX if 65 <= c <= 70
    else LOW if 97 <= c <= 122 else UP if 65 <= c <= 90 else MARK
    for c in range(128)
}


def judged(kinds: list[int], total: int) -> int:
    """The place in ``KINDS`` of the class that a window is secret-like in, or -1, by its counts of kinds and sum of parts."""
    digits, low, up = kinds[DIGIT], kinds[LOW_HEX] + kinds[LOW], kinds[UP_HEX] + kinds[UP]
    if digits < 2 or low + up < 2:
        return -1
    if kinds[MARK]:
        mixed, kind = low >= 2 and up >= 2, "entropy_base64"
    elif kinds[LOW] or kinds[UP] or (low and up):
        mixed, kind = True, "entropy_alnum"
    else:
        mixed, kind = True, "entropy_hex"
    return KINDS.index(kind) if mixed and total <= MOST[kind] else -1


def dense(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the spans of high entropy in a candidate."""
    count: dict[str, int] = dict.fromkeys(text, 0)
    kinds, total = [0] * 6, 0
    found: list[tuple[int, int, int]] = []
    for k, c in enumerate(text):
        total += PART[count[c] + 1] - PART[count[c]]
        count[c] += 1
        kinds[CLASS[c]] += 1
        start = k + 1 - WINDOW
        if start < 0:
            continue
        if (kind := judged(kinds, total)) >= 0:
            if found and start <= found[-1][2]:
                found[-1] = (found[-1][0], max(found[-1][1], kind), k + 1)
            else:
                found.append((start, kind, k + 1))
        gone = text[start]
        total += PART[count[gone] - 1] - PART[count[gone]]
        count[gone] -= 1
        kinds[CLASS[gone]] -= 1
    return found


def spans(text: str, allow: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of all spans of a text, in code points, sorted."""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    more = []
    # what the other shapes match has characters of candidates only, and is as long
    for c in CANDIDATE.finditer(text):
        run, at = c[0], c.start()
        found += [(at + m.start(), at + m.end(), kind) for kind, shape in ((1, ACCESS), (2, HEX)) for m in shape.finditer(run)]
        if (new := dense(run)) and run not in allow and not ALLOWED.fullmatch(run) and not PLACEHOLDER.search(run):
            more += [(at + s, at + e, kind) for s, kind, e in new]
    more = [(s, e, kind) for s, e, kind in more if not any(a <= s and e <= b for a, b, _ in found)]
    return sorted((s, kind, e) for s, e, kind in found + more)


def scanned(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = (), into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: the array of spans (kind, start, end), sorted by start, then kind as in ``KINDS``.

    Positions are code points, the end exclusive.  ``allow`` has further strings, whole
    candidates, whose entropy is no matter.  Null texts are read as empty; they and texts without
    secrets have an empty array.  Texts are scanned whole, whatever their length.  Repeated rows
    each have their own result; an empty table stays empty.  Other columns pass through; one that
    is named as ``into`` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"the table has a column {into}; pass another name in 'into'")
    known = frozenset(allow)

    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans(t, known)] for t in texts])

    def span(x: Column) -> Column:
        part = lambda k: F.split_part(x, F.lit(":"), F.lit(k))
        return F.struct(part(1).alias("kind"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))

    return docs.withColumn(into, F.transform(scan(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), span))


def written_as(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, found: str = "secrets", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of a scanned table."""
    spans_of = F.col(found)
    of = lambda *kinds: F.filter(spans_of, lambda x: x["kind"].isin(*kinds))
    number = lambda *kinds: F.size(of(*kinds)).cast("long")
    return docs.select(
        id_col,
        *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        number(*KINDS[len(BASE_KINDS) :]).alias("n_entropy"),
        F.sha2(written_as(of(*BASE_KINDS)), 256).alias("base_sha256"),
        written_as(spans_of).alias("spans"),
    )
