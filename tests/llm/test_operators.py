"""The training-data operators on small fixtures: brute force, round trips, edge cases."""

from __future__ import annotations

import glob
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format, decontaminate, line_dedup, mixing, oracle, quality_rules, queries, simhash, toxicity, url_filters,
    warc, weak_quality,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __p string, h string"
WORDS = "the of and river house green table stone light winter paper window garden market silver morning".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) + ("." if r.random() < 0.15 else "") for _ in range(n))


def docs_of(spark, rows):
    """Documents with extra columns, whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n "), (None, "a null id."), (4, "same text here."), (4, "same text here."), (4, "other text."), (5, prose(9, 20_000))]


@pytest.mark.parametrize("key", sorted(oracle.SQL))
def test_like_duckdb(spark, key):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = queries.QUERIES[key](spark, SF), con.sql(oracle.SQL[key])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    flat = lambda cols, data: sorted(str([r[cols.index(n)] for n in names]) for r in data)
    assert flat(ours.columns, [tuple(r) for r in ours.collect()]) == flat(theirs.columns, theirs.fetchall())


def test_simhash_against_all_pairs(spark):
    base = prose(1, 300)
    rows = [(k, prose(k, 60)) for k in range(40)] + [(100 + k, base + f" tail{k}") for k in range(6)] + ODD
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = [int(r["fingerprint"], 16) for r in got]
    root = list(range(len(got)))
    for _ in range(len(got)):
        for a in range(len(got)):
            for b in range(len(got)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    for k, r in enumerate(got):
        ids = [x["doc_id"] for j, x in enumerate(got) if root[j] == root[k] and x["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert len(got) == len(rows)


def test_one_of_each_keeps_the_first(spark):
    base = prose(1, 400).split()
    near = base[:200] + ["changed"] + base[201:]
    rows = [(7, " ".join(near)), (3, " ".join(base)), (9, " ".join(base)), (11, prose(5, 400)), *ODD]
    kept = simhash.one_of_each(docs_of(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 11 in ids and 7 not in ids and 9 not in ids
    assert ids.count(4) == 2 and len({1, 2, 3} & set(ids)) == 2  # one of the empty texts


def test_bounded_groups_link_the_same(spark, monkeypatch):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    points = list({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for b in base for _ in range(12)})
    prints = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in points], "fp long")
    whole = sorted(map(tuple, simhash.link(prints).collect()))
    monkeypatch.setattr(simhash, "GROUP_ROWS", 60)
    monkeypatch.setattr(simhash, "SAMPLE", 200)
    assert whole == sorted(map(tuple, simhash.link(prints).collect())) and len(whole) > 300


def test_similar_groups_against_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    texts = []
    for k in range(12):
        base = prose(k, 120).split()
        for _ in range(6):
            own = list(base)
            for at in r.sample(range(120), r.choice([0, 1, 2, 3, 5, 8])):
                own[at] = f"edit{r.random()}"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in range(6):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for own in (simhash.OWN, 20):  # 20: many blocks and chunks
        monkeypatch.setattr(simhash, "OWN", own)
        kept = {x["doc_id"] for x in simhash.one_of_each(docs_of(spark, list(enumerate(texts)))).collect()}
        want = set(root)
        assert want <= kept  # nothing goes without a partner of 0.8
        assert len(kept - want) <= 0.1 * (len(texts) - len(want))  # recall of 0.9 at least
    assert simhash.one_of_each(docs_of(spark, [(1, "x")]).where("false")).count() == 0


def family_points(seed, families, each, bits):
    """Long prints of some families and of as many strangers, with sizes; none is in a ball of a stranger."""
    r = np.random.default_rng(seed)
    prints = []
    for _ in range(families):
        base = r.integers(0, 2, 512)
        for _ in range(each):
            own = base.copy()
            own[r.choice(512, r.integers(0, bits), replace=False)] ^= 1
            prints.append(own)
    prints += list(r.integers(0, 2, (families * each, 512)))
    words = np.packbits(np.array(prints, np.uint8), axis=1, bitorder="little").view("<u8")
    sizes = np.concatenate((r.integers(100, 108, len(words) // 2), r.integers(0, 900, len(words) - len(words) // 2)))
    return np.column_stack((words, sizes.astype(np.uint64)))


def test_vantage_points_lose_no_pair_of_a_ball(monkeypatch):
    monkeypatch.setattr(simhash, "BRANCH", 20)
    points, apart = family_points(1, 6, 60, 60), simhash.metric(0.8)
    near = np.array([apart(points, v) <= 1 for v in points])
    bits = np.bitwise_count(points[:, None, :8] ^ points[None, :, :8]).sum(2, dtype=np.int64)
    sizes = points[:, 8].astype(float)
    ratio = np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes)
    assert (near == ((bits <= simhash.bits_at(0.8, 512, 3.0)) & ratio)).all() and near.sum() > 2 * len(points)
    every = np.arange(len(points))
    # shards: each point has one home, and a ball reaches all the homes of its points
    tree = simhash.grow(points[::3], 5, 0, apart, (simhash.EMPTY,))
    home = {int(p): shard for own, shard in simhash.routes(tree, points, 0, apart) for p in own}
    seen = {(int(p), shard) for own, shard in simhash.routes(tree, points, simhash.REACH, apart) for p in own}
    assert len(set(home.values())) > 16 and len(seen) < 0.7 * len(points) * len(set(home.values()))
    assert all((a, home[b]) in seen for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    # inside a shard, where all have about one size, fingerprints prune too
    for at in (every, every[: len(every) // 2]):
        met, pairs = np.zeros_like(near), 0
        for own, ask in simhash.branches(points, at, at, apart):
            met[np.ix_(ask, own)], pairs = True, pairs + len(own) * len(ask)
        assert met[near & np.isin(every, at)[:, None] & np.isin(every, at)].all() and pairs < 0.8 * len(at) ** 2


def test_pipeline_links_near_copies_through_the_tree(spark, monkeypatch):
    import corpus_pipeline

    grown, whole = [], simhash.grow
    monkeypatch.setattr(simhash, "grow", lambda *how: grown.append(whole(*how)) or grown[-1])
    base = [prose(k, 60 + 20 * k).split() for k in range(30)]
    near = [[*b[: 30 + k], "changed", *b[31 + k :]] for k, b in enumerate(base)]
    kept = corpus_pipeline.near_dedup(spark, docs_of(spark, list(enumerate(" ".join(t) for t in base + near))), SF)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in base + near]
    alike = {k for k in range(30) if len(sets[k] & sets[k + 30]) >= 0.8 * len(sets[k] | sets[k + 30])}
    assert {r["doc_id"] for r in kept.collect()} == set(range(60)) - {k + 30 for k in alike} and len(alike) > 20
    assert any(grown) and all(len(vantage) == simhash.WORDS + 1 for vantage, *_ in filter(None, grown))


def test_similar_groups_scale_with_jaccard():
    base = prose(1, 500).split()
    far = base[:250] + prose(2, 250).split()
    words = lambda t: np.frombuffer(simhash.long_simhash(" ".join(t))[0], "<u8")
    apart = lambda a, b: int(np.bitwise_count(words(a) ^ words(b)).sum())
    assert apart(base, [*base[:-3], "x", "y", "z"]) < simhash.bits_at(0.8, 512) < apart(base, far)


def test_line_dedup_cuts_later_passages_only(spark):
    passage = prose(77, 60) + "."
    one, two = prose(1, 40) + ".", prose(2, 40) + "."
    rows = [(1, f"{one} {passage} {two}"), (2, f"{two[:30]} {passage} {one[:25]}\nown end here."), (3, prose(3, 80)), *[(i + 10 if i else i, t) for i, t in ODD]]
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    inner = " ".join(passage.split(". ")[1].split()[:3])
    assert inner in got[1]["text"] and inner not in got[2]["text"]
    assert "own end here." in got[2]["text"] and got[2]["__cut"]["words"] >= 30
    assert got[3]["text"] == rows[2][1] and got[15]["text"] == ODD[-1][1] and got[11]["text"] is None


def test_line_dedup_repeats_within_a_text_and_hot_line(spark):
    header = "This is the common header line of every single page here."
    rows = [(k, f"{header}\n{prose(k, 30)}\n{prose(k + 500, 30)}") for k in range(30)]
    rows.append((99, f"{prose(5000, 30)}.\n{prose(6000, 30)}.\n{prose(5000, 30)}."))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert header in got[0] and all(header not in got[k] for k in range(1, 30))
    assert len(got[99].split()) < 90


def test_line_dedup_cuts_single_long_lines(spark):
    line = lambda k: prose(k, 60).replace(".", "")
    rows = [(2 * k + j, f"{line(10_000 + 4 * k + j)}\n{line(k)}\n{line(20_000 + 4 * k + j)}") for k in range(60) for j in (0, 1)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert [got[2 * k]["__cut"]["words"] for k in range(60)] == [0] * 60
    assert [got[2 * k + 1]["__cut"]["words"] for k in range(60)] == [60] * 60


def line_pieces(text):
    ends = [m.end() for m in re.finditer(r"([.!?;:][^\x20\x09-\x0D\w]{0,3})([ \t\r\x0b\x0c]+)|(\n)", text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def without_repeats(rows, least=10):
    """Cuts what lies in a run of ``least`` words that is equal to one that starts earlier, by comparing all places."""
    seen, out = [], {}
    for i, text in rows:
        parts = line_pieces(text)
        words = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts]
        own = [(k, w) for k, w in enumerate(words) if w]
        seen.append(own)
        cut = set()
        for s in range(len(own)):
            for other in seen:
                for r in range(s if other is own else len(other)):
                    n = 0
                    while s + n < len(own) and r + n < len(other) and own[s + n][1] == other[r + n][1]:
                        n += 1
                    if sum(x.count(" ") + 1 for _, x in own[s : s + n]) >= least:
                        cut |= set(range(own[s][0], own[s + n][0] if s + n < len(own) else own[-1][0] + 1))
        out[i] = "".join(p for k, p in enumerate(parts) if k not in cut)
    return out


@pytest.mark.parametrize("often", [8, 1])
def test_line_dedup_against_all_places(spark, monkeypatch, often):
    monkeypatch.setattr(line_dedup, "OFTEN", often)  # 1: values of the sample are hot
    r = random.Random(often)
    stock = [r.choice([" ", " ", "\t", "  "]).join(f"w{r.randrange(6)}" for _ in range(n)) + "." for n in [1, 2, 3, 3, 4, 5, 6, 8, 9, 10, 12, 15] * 2]
    rows = []
    for i in range(60):
        parts = [(r.choice(stock) if r.random() < 0.85 else f"own{i}x{r.randrange(9)}  \ue000 b.") + r.choice([" ", "\n", "  ", "\n\n", "\n \n", "\ue001 ", "\t", "\r\n", " \x0b"]) for _ in range(r.randrange(1, 14))]
        rows.append((i, "".join(parts)))
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup(docs_of(spark, rows)).collect()}
    want = without_repeats(rows)
    assert got == want and sum(want[i] != t for i, t in rows) > 30


@pytest.mark.parametrize("least", [1, 4])
def test_line_dedup_takes_any_number_of_words(spark, least):
    r = random.Random(least)
    stock = [" ".join(f"w{r.randrange(4)}" for _ in range(n)) + "." for n in [1, 1, 2, 3, 4, 5, 7]]
    rows = [(i, "".join((r.choice(stock) if r.random() < 0.6 else f"own{i}x{k}.") + r.choice([" ", "\n", "\n\n"]) for k in range(r.randrange(1, 9)))) for i in range(25)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup(docs_of(spark, rows), min_words=least).collect()}
    assert got == without_repeats(rows, least)


def test_line_dedup_finds_windows_in_compiled_code(spark):
    none = "array<int>"
    cut = spark.createDataFrame([(1, 2, [0, 1, 3], [7, 8, 9], [4, 12, 3], [2])], f"id long, t int, i {none}, h array<long>, w {none}, at {none}")
    for df in (line_dedup.prints(cut, 10), line_dedup.windows(cut, 10)):
        assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()
    # the long piece, with the short one before it, and with the one behind it
    got = {(r["p"] & line_dedup.LOW, r["e"]) for r in line_dedup.windows(cut, 10).collect()}
    assert got == {(1, 2), (0, 2), (1, 3)}


def test_line_dedup_knows_words_by_any_white_space(spark):
    table = "\t".join(f"cell{k}" for k in range(30))
    rows = [(1, f"{prose(1, 20)}\n{table}\nend one"), (2, f"own\r\n{table}\r\nend two"), (3, f"other\n{table.replace(chr(9), ' ')}\nend"), (4, f"é\t{prose(4, 9)}\n  {table.replace(chr(9), '  ')} \nlast")]
    got = {r["doc_id"]: (r["text"], r["__cut"]["words"]) for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("own\r\nend two", 30) and got[3] == ("other\nend", 30)
    assert got[4] == (f"é\t{prose(4, 9)}\nlast", 30)


def test_line_dedup_keeps_private_characters_and_takes_empty_tables(spark):
    run = "Six words stand in here once. Five more words in here."
    rows = [(k, f"\ue000\ue001 own{k} \ue000. {run} \ue001 tail{k}.") for k in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"\ue000\ue001 own{k} \ue000. \ue001 tail{k}." for k in range(1, 40))
    assert line_dedup.dedup(docs_of(spark, rows).where("false")).count() == 0
    assert line_dedup.without_repeats(docs_of(spark, [(1, run), (2, run), (3, ""), (4, None)])).count() == 3


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 150 + "\r\n\r\nWARC/1.1\r\n é"
    rows = [(5, "http://b.org/1", long), (2, "http://a.b.org/2", long), (9, None, long), (7, "http://b.org/1", "short"), (8, "http://c/", "short"), (1, "u", None), (None, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    found = warc.merged(warc.index(spark, str(tmp_path / "w"))).collect()
    kind = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_ok"]) for r in found}
    size = len(long.encode())
    assert kind == {5: ("revisit", 2, size, True), 2: ("response", None, size, True), 9: ("revisit", 2, size, True), 7: ("response", None, 5, True),
                    8: ("response", None, 5, True), 1: ("response", None, 0, True), None: ("revisit", 2, size, True)}
    keys = [(r["urlkey"], r["ts"]) for r in found]
    assert keys == sorted(keys)


def test_warc_times_large_records_and_clashing_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 50_000)  # records take several members
    big = prose(3, 60_000)
    rows = [(1, "http://a/", big, None, "x"), (2, "http://a/", "y", "2024-05-05T00:00:00", "x"), (3, "http://a/", None, "2023-05-05T00:00:00", "z"), (3, "http://a/", None, "2023-05-05T00:00:00", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at string, digest string")
    found = warc.captures(pages, time_col="fetched_at").collect()
    assert [r["page_id"] for r in found] == [1, 3, 3, 2] and found[0]["ts"] is None and all(r["payload_ok"] for r in found)
    assert found[0]["payload_bytes"] == len(big)
    assert warc.captures(pages).count() == 4 and warc.captures(pages.where("false")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(((str(r.randrange(9)), "t", r.randrange(50), None, "", None, 0, "", True, f"f{j}", n) for n in range(r.randrange(20))), key=warc.order) for j in range(k)]
    assert list(warc.loser_tree(runs)) == sorted((x for run in runs for x in run), key=warc.order)


def test_decontamination(spark):
    item = "A train leaves the Station with Anna and Bernd at 12 km per hour, then Anna walks 5 miles to the old market square in silence."
    other = item.replace("Anna", "Clara").replace("Bernd", "Dora").replace("12", "47").replace("5 miles", "8 miles")
    mixed = item.replace("with Anna", "with Emil").replace("12", "47")  # Anna is two people now
    bench = spark.createDataFrame([(1, item), (2, None), (3, "Too few."), (1, item)], "item_id long, text string")
    rows = [(10, prose(1, 30) + ". " + item + " " + prose(2, 30)), (11, other), (12, mixed), (13, prose(4, 200)), *[(i + 20 if i else i, t) for i, t in ODD]]
    got = {r["doc_id"]: r for r in decontaminate.found_items(docs_of(spark, rows), bench).collect()}
    assert got[10]["items"] == [1] and got[11]["items"] == [1]
    assert not got[12]["contaminated"] and not got[13]["contaminated"] and not got[21]["contaminated"]
    left = decontaminate.clean(docs_of(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {12, 13, 21, 22, 23, None, 24, 25} and left.count() == len(rows) - 2
    none = decontaminate.found_items(docs_of(spark, rows), bench.where("false"))
    assert none.count() == len(rows) and none.where("contaminated").count() == 0


def test_decontamination_looks_at_each_occurrence(spark):
    twice = "So we saw that there are 3 red apples in the big basket by the door and that there are 5 red apples in the big basket by the door."
    once = "A train leaves the Station with Anna at 12 km per hour and walks 5 miles to the old market square in silence."
    variant = once.replace("Anna", "Clara").replace("12", "47")
    longer = once.replace("to the old", "to the very old")
    bench = spark.createDataFrame([(1, twice), (2, once)], "item_id long, text string")
    rows = [(1, twice), (2, f"{once} {prose(3, 20)}. {variant}"), (3, f"{longer} {prose(4, 20)}. {variant}"), (4, longer), (5, prose(6, 90))]
    got = {r["doc_id"]: r["items"] for r in decontaminate.found_items(docs_of(spark, rows), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [2], 4: [2], 5: []}


def test_decontamination_finds_items_with_few_literal_tokens(spark):
    items = ["What is 12 + 7?", "Anna Bernd Clara Dora Emil Frida Gustav Hanna Ida Jakob", "Green apples fall from trees", "Paris"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(k, f"{prose(k, 20)} and {x} {prose(k + 50, 20)}") for k, x in enumerate(items)] + [(9, "and what is 12 + 8 then"), (10, items[0])]
    got = {r["doc_id"]: r["items"] for r in decontaminate.found_items(docs_of(spark, rows), bench).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [], 9: [], 10: [0]}


def test_chat_links_orders_and_validates(spark):
    call = lambda i, args, deps="": f'<tool_call>{{"id":"{i}","name":"add","arguments":{args}{deps}}}</tool_call>'
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "assistant", call("a", '{"y":2,"x":1.50}') + call("b", '{"x":"1","z":0}', ',"depends_on":["a"]')),
        (1, 2, "tool", '<tool_result>{"id":"a","content":"3"}</tool_result><tool_result>{"id":"q","content":"?"}</tool_result>'),
        (1, 3, "assistant", call("c", "{}", ',"depends_on":["d"]') + call("d", "{}", ',"depends_on":["c"]')), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 1, "assistant", "hello"), (None, None, None, None),
    ]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["kind"], r["call_id"]): r for r in chat_format.formatted(chat, {"add": {"x": ("number", True), "y": ("number", False)}, "reply": {"prompt": ("string", True)}}).collect()}
    a, b = got[1, "call", "a"], got[1, "call", "b"]
    assert (a["status"], a["level"], a["errors"]) == ("answered", 0, "") and '"arguments":{"x":1.5,"y":2}' in a["json"]
    assert (b["status"], b["level"]) == ("unanswered", 1) and "unknown: z" in b["errors"] and "not number: x" in b["errors"]
    assert got[1, "call", "c"]["level"] is None and "missing: x" in got[1, "call", "c"]["errors"]
    assert got[1, "result", "a"]["level"] == 1 and got[1, "result", "q"]["status"] == "orphan"
    assert got[2, "call", "turn:0"]["status"] == "answered" and got[2, "result", "turn:0"]["status"] == "linked"
    assert chat_format.formatted(chat.where("false")).count() == 0


def test_chat_levels_of_chains_merges_and_cycles(spark):
    r = random.Random(2)
    needs = {f"n{k}": [f"n{k - 1}"] if k else [] for k in range(40)}
    needs |= {f"m{k}": [f"n{r.randrange(40)}", f"m{k - 1}" if k else "n0", "gone"] for k in range(4)}
    needs |= {"c0": ["c1"], "c1": ["c0"], "c2": ["c1", "n3"], "s": ["s"]}
    rows = [(1, i, d or None) for i, d in needs.items()]
    own = spark.createDataFrame(rows, "conv_id long, id string, depends_on array<string>")
    level: dict[str, int] = {}
    for _ in range(60):
        for i, d in needs.items():
            deps = [x for x in d if x in needs]
            if all(x in level for x in deps):
                level[i] = max((level[x] + 1 for x in deps), default=0)
    assert {x["id"]: x["level"] for x in chat_format.levels(own).collect()} == {i: level.get(i) for i in needs}


def test_chat_keeps_text_around_markup_and_broken_markup(spark):
    rows = [(1, 0, "assistant", 'Let me see. <tool_call>{"id":"a","name":"f","arguments":{}}</tool_call> And <tool_call>{"id": oops</tool_call> done.'),
            (1, 1, "tool", 'before <tool_result>{"id":"a","content":"3"}</tool_result><tool_result>[no</tool_result>\n'), (1, 2, "assistant", '<tool_call>{"id":"b","name":"f"}</tool_call>\n')]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["turn"], r["kind"], r["part"]): r for r in chat_format.formatted(chat, {"f": {}}).collect()}
    assert sorted(got) == [(0, "call", 0), (0, "call", 1), (0, "message", 0), (1, "message", 0), (1, "result", 0), (1, "result", 1), (2, "call", 0)]
    assert got[0, "message", 0]["json"] == '{"content":"Let me see.  And  done.","kind":"message","role":"assistant"}'
    assert '"content":"before ' in got[1, "message", 0]["json"] and got[0, "call", 0]["errors"] == got[2, "call", 0]["errors"] == ""
    assert (got[0, "call", 1]["errors"], got[0, "call", 1]["json"]) == ("broken markup", '{"kind":"call","raw":"{\\"id\\": oops"}')
    assert (got[1, "result", 1]["errors"], got[1, "result", 1]["json"]) == ("broken markup", '{"kind":"result","raw":"[no"}')


def test_quality_rules_against_plain_python(spark):
    rows = [(k, prose(k, 40) + ("\nsame line here\nsame line here" if k % 3 == 0 else "")) for k in range(20)] + ODD + [(70, "the a b c d e the a b c d e x y z w v"), (71, "# $ the of and to in is it on")]
    for r in quality_rules.judged(docs_of(spark, rows)).collect():
        text = next((t for i, t in rows if i == r["doc_id"] and len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == r["n_words"]), "missing")
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\f\v")]
        want = (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_url_filters_at_the_edges(spark):
    entries = spark.sql("SELECT * FROM VALUES ('a.org','block',timestamp'2024-01-10'), ('a.org','remove',timestamp'2024-02-10'), ('x.a.org','allow',timestamp'2024-01-20'), (null,'block',timestamp'2024-01-01'), ('a.org','block',timestamp'2024-01-10') AS t(pattern, action, listed_at)")
    captures = spark.sql("SELECT * FROM VALUES (1,'http://a.org/',timestamp'2024-01-10'), (2,'http://a.org/',timestamp'2024-02-10'), (3,'http://X.a.org:80/',timestamp'2024-01-25'), (4,'http://y.a.org/',timestamp'2024-01-25'), (5,null,timestamp'2024-01-25'), (6,'http://a.org/',null), (1,'http://a.org/',timestamp'2024-01-10') AS t(page_id, url, fetched_at)")
    got = [(r["page_id"], r["verdict"]) for r in url_filters.evaluate(captures, entries).collect()]
    assert sorted(got) == [(1, "block"), (1, "block"), (2, "none"), (3, "allow"), (4, "block"), (5, "none"), (6, "none")]
    assert {r["verdict"] for r in url_filters.evaluate(captures, entries.where("false")).collect()} == {"none"}


def test_mixing_meets_targets(spark):
    rows = [(k, (f"alpha{k % 7} apple " if k % 4 else f"beta{k % 5} berry ") * (5 + k % 9)) for k in range(200)] + [(900, None), (901, "")]
    domains = spark.createDataFrame([(k, "a" if k % 4 else "b") for k in range(0, 200, 2)] + [(None, "a"), (3, None)], "doc_id long, domain string")
    got = mixing.mix(docs_of(spark, rows), domains, {"a": 0.4, "b": 0.6}).collect()
    total = sum(r["tokens"] for r in got)
    mass = {d: sum(r["rate"] * r["tokens"] * r["posterior"][d] for r in got) for d in "ab"}
    assert mass["a"] == pytest.approx(0.4 * total, rel=1e-3) and mass["b"] == pytest.approx(0.6 * total, rel=1e-3)
    assert all(r["rate"] >= 0 for r in got) and len(got) == len(rows)
    assert all(r["domain"] == ("a" if r["doc_id"] % 4 else "b") for r in got if r["doc_id"] < 200)
    assert mixing.mix(docs_of(spark, rows).where("false"), domains).count() == 0
    assert max(r["misfit"] for r in got) < 1e-3
    with pytest.raises(ValueError, match="unknown"):
        mixing.mix(docs_of(spark, rows), domains, {"a": 0.4, "c": 0.6})
    assert {round(r["rate"], 9) for r in mixing.mix(docs_of(spark, rows), domains.where("false")).collect()} == {1.0}


def test_toxicity_on_the_held_out_fold(spark):
    path = "/root/testdata/sf0.01"
    got = queries.op9_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)
    tagger = toxicity.train(docs_of(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs_of(spark, ODD), tagger).where("score between 0 and 1").count() == len(ODD)


def test_forward_backward_against_enumeration():
    import itertools

    r = np.random.default_rng(1)
    emission, edge = r.normal(size=5), r.normal(size=4)
    start, t01, t10, t11 = edge
    weight = {}
    for y in itertools.product((0, 1), repeat=5):
        s = sum(e for e, v in zip(emission, y, strict=True) if v) + (start if y[0] else 0)
        s += sum({(0, 1): t01, (1, 0): t10, (1, 1): t11}.get(p, 0.0) for p in itertools.pairwise(y))
        weight[y] = np.exp(s)
    exact = [sum(w for y, w in weight.items() if y[k]) / sum(weight.values()) for k in range(5)]
    assert toxicity.marginals(toxicity.Chains.of(np.array([5])), emission, edge) == pytest.approx(exact, rel=1e-6)


def test_weak_labels(spark):
    model = weak_quality.fit_votes({"111111111": 800, "000001000": 150, "1-1111-11": 50})
    assert model.posterior("111111111") > 0.9 > 0.1 > model.posterior("000001000")
    path = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    odd = weak_quality.classify(docs_of(spark, ODD))
    assert odd.count() == len(ODD) and odd.where("score = 0").count() == 3
    assert weak_quality.classify(docs_of(spark, ODD).where("false")).count() == 0


def test_pipeline_on_planted_cases(spark):
    import corpus_pipeline
    from tidemark.llm.common import table, written

    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100
    assert docs.where(F.col("rate") < 0).count() == 0 and {"text", "lang", "source"} <= set(docs.columns)


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    import shutil

    import corpus_pipeline

    sf = tmp_path / "sf"
    shutil.copytree(SF, sf)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    own, near = prose(900, 200), prose(901, 200).split()
    passage = " ".join(f"shared{k} words." if k % 8 == 7 else f"shared{k}" for k in range(64))
    planted = [
        (10**6, f"{own} {passage} {prose(902, 60)}"), (10**6 + 1, f"{prose(903, 60)}. {passage} {prose(904, 60)}"),
        (10**6 + 2, " ".join(near)), (10**6 + 3, " ".join([*near[:100], "edited", *near[101:]])), (10**6 + 4, f"{prose(905, 40)}. {item} {prose(906, 40)}"), (10**6 + 5, None), (10**6 + 6, ""),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more)
    left = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, left, str(sf))
    found = {r["doc_id"]: r["text"] for r in left.where("doc_id >= 1000000").collect()}
    assert "shared11 " in found[10**6] and "shared11 " not in found[10**6 + 1] and 10**6 + 2 in found
    # line dedup has cut what the near copy repeats, so it is no near copy any more
    assert 10**6 + 4 not in found and len(found.get(10**6 + 3, "").split()) < 60
