"""Secret scans, source divergence and spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, secrets, spelling

DOCS = "doc_id long, text string, lang string, source string, secrets_ string, term binary, word string, n long, salt string"


def docs_of(spark, rows):
    """Documents (id, text, lang, source) with further columns, whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", b"y", "w", 7, "z") for r in rows], DOCS)


# secrets


def plain_windows(run: str) -> list[tuple[int, int, int]]:
    """The dense spans of a candidate, each window counted anew."""
    found = []
    for s in range(len(run) - secrets.WINDOW + 1):
        w = run[s : s + secrets.WINDOW]
        bits = -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
        digits, low, up = (len(re.findall(p, w)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
        if digits < 2 or low + up < 2:
            continue
        if re.search("[^A-Za-z0-9]", w):
            kind = "entropy_base64" if low >= 2 and up >= 2 else None
        else:
            kind = "entropy_hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else "entropy_alnum"
        if kind and bits >= secrets.LEAST_BITS[kind] - 1e-4:
            place = secrets.KINDS.index(kind)
            if found and s <= found[-1][2]:
                found[-1] = (found[-1][0], max(found[-1][1], place), s + len(w))
            else:
                found.append((s, place, s + len(w)))
    return found


def plain_spans(text: str) -> list[str]:
    base = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer("[A-Za-z0-9+/=_-]+", text):
        if len(m[0]) >= 20 and not secrets.ALLOWED.fullmatch(m[0]) and not secrets.PLACEHOLDER.search(m[0]):
            more += [(secrets.KINDS[k], m.start() + s, m.start() + e) for s, k, e in plain_windows(m[0])]
    more = [x for x in more if not any(a <= x[1] and x[2] <= b for _, a, b in base)]
    every = sorted(base + more, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))
    return [":".join(map(str, x)) for x in every]


def odd_text(r: random.Random) -> str:
    parts = [
        lambda: r.choice(["token", "Api_Key", "PASSWORD", "secret", "paßword", "toKen"]) + r.choice(["=", ": ", '" : "', "", " =  '"]),
        lambda: "AKIA" + "".join(r.choices("ABCDEFGH0123456789", k=r.randrange(10, 24))),
        lambda: "".join(r.choices("0123456789abcdef", k=r.randrange(15, 50))),
        lambda: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=r.randrange(10, 60))),
        lambda: "".join(r.choices("aab1", k=30)),
        lambda: r.choice([" ", "\n", "é ", "𝕏", ", ", "Donaudampfschifffahrtsgesellschaft ", "src/main/java/example/Thing2024.java "]),
    ]
    return "".join(r.choice(parts)() for _ in range(r.randrange(1, 12)))


def test_spans_are_those_of_brute_force():
    r = random.Random(11)
    kinds = Counter()
    for _ in range(3000):
        text = odd_text(r)
        got = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.spans(text)]
        assert got == plain_spans(text), text
        kinds.update(x.split(":")[0] for x in got)
    assert set(kinds) == set(secrets.KINDS)


def test_steps_of_a_window_leave_no_error():
    r = random.Random(3)
    run = "".join(r.choices("ABCdef0123+/", k=20_000))
    assert secrets.dense(run) == plain_windows(run)


def test_secrets_found_and_suppressed():
    key = "q8Zr1TvXw0KpLm93NsYbHdJc"
    found = lambda t, **how: [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.spans(t, **how)]
    assert found(f"see {key} here") == [("entropy_alnum", key)]
    assert found(f"see {key} here", allow=frozenset([key])) == []
    assert found("id 550e8400-e29b-41d4-a716-446655440000 of") == []
    assert found("q8Zr1TvXw0KpLm93NsYbEXAMPLE") == []
    assert found("token=abc") == [] and found("token=abcdef") == [("assign", "token=abcdef")]
    # a failing match is used up all the same
    assert found("secret=token:abcdefgh") == []
    # only ASCII letters have another case here
    assert found("toKen=abcdefgh") == [] and found("TOKEN=abcdefgh") == [("assign", "TOKEN=abcdefgh")]


def test_secret_digest_on_odd_tables(spark):
    long = "é " * 300_000 + "password: hunter2hunter2"
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, long, "en", "s"), (4, "a", "en", "s"), (4, "a", "en", "s"), (None, "token='abcdefg'", None, None)]
    docs = docs_of(spark, rows)
    got = {(r["doc_id"], r["spans"]): r for r in secrets.digest(secrets.scanned(docs)).collect()}
    assert (3, "assign:600000:600024") in got and (None, "assign:0:14") in got
    assert got[1, ""]["base_sha256"] == got[2, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None, "assign:0:14"]["base_sha256"] == hashlib.sha256(b"assign:0:14").hexdigest()
    assert secrets.scanned(docs).columns == [*docs.columns, "secrets"] and secrets.scanned(docs).count() == 6
    assert secrets.digest(secrets.scanned(docs.limit(0))).collect() == []
    with pytest.raises(ValueError, match="pass another name"):
        secrets.scanned(docs, into="word")


# divergence


def plain_audit(rows, min_docs, top=divergence.TOP):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    df, n = Counter(), Counter()
    for t, lang, s in rows:
        df.update((lang, w) for w in set(terms(t)))
        n.update((lang, s, w) for w in terms(t))
    groups = {(lang, s) for _, lang, s in rows}
    kept = defaultdict(list)
    for (lang, w), k in df.items():
        if k >= min_docs:
            kept[lang].append(w)
    p = {}
    for lang, s in groups | {(lang, None) for lang, _ in groups}:
        own = {w: sum(n[lang, x, w] for la, x in groups if la == lang and s in (None, x)) for w in kept[lang]}
        total, v = sum(own.values()), len(own)
        p[lang, s] = {w: (1 + 10**9 * (k + 2) // (total + 2 * v), k) for w, k in own.items()}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, s in groups:
        own = p[lang, s]
        pairs = [(x, sum(f(own[w][0], p[lang, x][w][0]) for w in own)) for la, x in groups if la == lang and x != s]
        words = [(w, f(q, p[lang, None][w][0])) for w, (q, k) in own.items() if k and q > p[lang, None][w][0]]
        for part, items in (("pair", pairs), ("term", words)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def odd_corpus(seed: int, n: int):
    r = random.Random(seed)
    words = ["The", "the", "of", "é", "É", "日本", "x1y", "a_b", "\x7f", "ß", "zeta", "Zeta", "mu", "nu"]
    text = lambda: r.choice([None, "", " ".join(r.choices(words, weights=range(20, 6, -1), k=r.randrange(40)))])
    return [(k % 50, text(), r.choice(["en", "de", None, "", "xx"]), r.choice(["a", "b", "c", None, "é"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "STREAM_TERMS", 3)  # several streams of a language
    rows = odd_corpus(seed, 150) + [(1, None, "lone", "only"), (2, "rare words", "none", "a"), (3, "too rare", "none", "b")]
    got = divergence.audit(docs_of(spark, rows).repartition(5), min_docs=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 4)


def batches_of(schema, rows, size):
    return [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[k : k + size]], schema) for k in range(0, len(rows), size)]


def test_divergence_with_small_bounds(monkeypatch):
    """Every flush and every early sum of the streams, without Spark."""
    for name, value in (("HELD", 5), ("CELLS", 30), ("ROWS", 7)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(k, t or "", lang or "", s or "") for k, (_, t, lang, s) in enumerate(odd_corpus(5, 120))]
    texts = pa.schema([("doc", pa.int64()), ("text", pa.binary()), ("lang", pa.string()), ("source", pa.string())])
    runs = [r for b in divergence.partial_runs(iter(batches_of(texts, [(d, t.encode(), la, s) for d, t, la, s in rows], 9))) for r in b.to_pylist()]
    runs.sort(key=lambda r: (r["lang"], r["term"], r["doc"]))
    run = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("docs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    in_batches = [batches_of(run, [tuple(r[c] for c in run.names) for r in runs], k) for k in (1, 3, 1000)]
    found = [[r for b in divergence.kept_runs(iter(some), 4) for r in b.to_pylist()] for some in in_batches]
    kept = sorted(found[0], key=lambda r: (r["lang"], r["term"]))
    assert all(sorted(f, key=lambda r: (r["lang"], r["term"])) == kept for f in found)
    totals, v = Counter(), Counter(r["lang"] for r in kept)
    for r in kept:
        for source, n in zip(r["sources"], r["n"], strict=True):
            totals[r["lang"], source] += n
    stream = pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("v", pa.int64())])
    sums, terms = Counter(), []
    for lang in sorted({r[2] for r in rows}):
        for salt in range(3):
            own = [(lang, salt, None, [s], [totals[lang, s]], v[lang]) for s in sorted({r[3] for r in rows if r[2] == lang})]
            own += [(lang, salt, r["term"], r["sources"], r["n"], 0) for r in kept if r["lang"] == lang and r["term"][0] % 3 == salt]
            for b in divergence.compared(iter(batches_of(stream, own, 4)), 3, 10**6):
                for r in b.to_pylist():
                    if r["part"] == "pair":
                        sums[r["lang"], r["source"], r["item"].decode()] += r["value"]
                    else:
                        terms.append((r["lang"], r["source"], r["item"].decode(), r["value"]))
    wanted = plain_audit([(d, t, la, s) for d, t, la, s in rows], 4, top=10**9)
    assert {k: v for k, v in sums.items()} == {(la, s, x): v for la, s, part, x, v, _ in wanted if part == "pair"}
    assert sorted(terms) == sorted((la, s, x, v) for la, s, part, x, v, _ in wanted if part == "term")


def test_shares_beyond_64_bits():
    n = 7 * 10**12
    assert divergence.share([n - 5, 0], n, 1000).tolist() == [1 + 10**9 * (n - 3) // (n + 2000), 1 + 2 * 10**9 // (n + 2000)]


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(docs_of(spark, [(1, "a", "b", "c")]).limit(0)).collect() == []


# spelling


def plain_variants(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = sorted(w for w, k in n.items() if len(w) >= 6 and k >= 5)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w in words:
        others = [x for x in words if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], form[w] and n[form[w]]))
    return out


def misspelt(seed: int):
    r = random.Random(seed)
    stems = ["colour", "colours", "ccolour", "harbour", "Harboür", "ÀÉÎÕÜß×", "aaaaaaa", "aaaaaab", "letters", "better"]
    words = Counter()
    for s in stems:
        words[s] += r.choice([5, 40, 400])
        for _ in range(12):
            k, c = r.randrange(len(s)), r.choice("abcéß")
            words[r.choice([s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :]])] += r.choice([3, 5, 6, 7, 30, 31, 200, 2000])
    bag = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(bag)
    texts = [r.choice([" ", "_", "9", "日"]).join(bag[k : k + 60]) for k in range(0, len(bag), 60)]
    return [(k % 90, t, "en", "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_are_those_of_brute_force(spark, seed):
    rows = [*misspelt(seed), (None, "colour " * 9 + "nullid " * 6, "en", "s"), (7, None, "en", "s"), (8, "", None, None)]
    got = spelling.variants(docs_of(spark, rows).repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    wanted = plain_variants(rows)
    assert sorted(tuple(r) for r in got) == wanted
    assert any(form and root != form for _, form, root, *_ in wanted)


def test_variants_of_very_long_words_and_of_nothing(spark):
    long = "".join(random.Random(1).choices("abcdefghij", k=3000))
    other = long[:1500] + "z" + long[1501:]
    rows = [(k, f"{long} {other}", "en", "s") for k in range(1, 6)]
    rows += [(k, long, "en", "s") for k in range(6, 40)]
    got = {r["word"]: (r["n_near"], r["form"]) for r in spelling.variants(docs_of(spark, rows)).collect()}
    assert got == {r[0]: (r[4], r[1]) for r in plain_variants(rows)} and long in got
    assert spelling.variants(docs_of(spark, rows).limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(21)] + [("a", "w20")], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain).collect()} == {"w21"}
    assert spelling.roots(chain.where(F.lit(False))).count() == 0
