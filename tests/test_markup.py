"""HTML made safe, against a walk over small trees."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import markup
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def tree(r, depth=0):
    """A node: a text, or (name, attributes, children)."""
    if depth > 4 or r.random() < 0.35:
        return r.choice(["word", " two words ", "a &amp; b", "é", " ", "x > y", ""])
    name = r.choice(["p", "ul", "li", "b", "em", "br", "div", "div", "span", "table", "script", "svg", "form", "button", "figure", "img", "h2"])
    attributes = r.choice(["", ' class="x"', ' class="a content-intro"', " style='y'"]) if name == "div" else r.choice(["", " id=1"])
    if name in markup.VOID:
        return (name, attributes, [])
    return (name, attributes, ["var x = '<b>';"] if name == "script" else [tree(r, depth + 1) for _ in range(r.randrange(4))])


def html(node):
    if isinstance(node, str):
        return node
    name, attributes, children = node
    return f"<{name}{attributes}>" + ("" if name in markup.VOID else "".join(map(html, children)) + f"</{name}>")


def walked(nodes):
    """The kept nodes, unwrapped; a kept element is (name, children)."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
        elif n[0] in markup.GONE or "content-intro" in n[1]:
            continue
        elif n[0] in markup.KEPT:
            out.append((n[0], walked(n[2])))
        else:
            out += walked(n[2])
    return out


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>" if node[0] == "br" else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"


def plain(nodes):
    out, run = "", []

    def flush():
        text = "".join(map(written, run))
        return f"<p>{text}</p>" if re.sub(r"<[^>]*>|\s", "", text) else ""

    for n in walked(nodes):
        if isinstance(n, tuple) and n[0] in markup.BLOCKS:
            out, run = out + flush() + written(n), []
        else:
            run.append(n)
    out += flush()
    out = re.sub(r"(<br\s*/?>\s*){3,}", "<br>", out)
    return re.sub(r"<p>\s*(<br\s*/?>|\s)*\s*</p>", "", out).strip()


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_are_walked_alike(spark, seed):
    r = random.Random(seed)
    pages = [[tree(r) for _ in range(r.randrange(5))] for _ in range(150)]
    df = spark.createDataFrame([(k, "".join(map(html, nodes))) for k, nodes in enumerate(pages)], "k long, html string")
    got = {x["k"]: x["html"] for x in markup.sanitized(df, "k", "html").collect()}
    for k, nodes in enumerate(pages):
        assert got[k] == plain(nodes), "".join(map(html, nodes))


def test_broken_markup(spark):
    cases = {
        "": "", "plain": "<p>plain</p>", "<script>alert('<p>')": "", "a</svg>b": "<p>ab</p>", "<svg><g>x</svg>y</g>": "<p>y</p>", "<form>a<form>b</form>c": "",
        "<div class='content-intro'><div>a</div>b</div><P ID=x>c</P>": "<p>c</p>", "&lt;p&gt;x&lt;/p&gt;": "<p>x</p>", "1 < 2 <b>x</b>": "<p>1 < 2 <b>x</b></p>",
        "<!-- <p>no</p> --><br><br/><br >a": "<p><br>a</p>", "<p>&nbsp;</p><p> <br> </p>z": "<p>z</p>", "<img src=x onerror=y>t": "<p>t</p>", "<ul><li>a<li>b</ul>": "<ul><li>a<li>b</ul>",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "k long, html string")
    got = {x["k"]: x["html"] for x in markup.sanitized(df, "k", "html").collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[99] == ""


def test_all_pages_are_safe(spark):
    found = registry.QUERIES["x18_sanitized"](spark, SF)
    tags = found.select(F.explode(F.regexp_extract_all("html", F.lit("<[a-zA-Z/][^>]*>"), F.lit(0))).alias("t")).distinct()
    assert {r["t"].strip("</>") for r in tags.collect()} <= set(markup.KEPT)
    assert found.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and found.where("html = ''").isEmpty()


def test_only_what_changes_is_written_again(spark):
    df = spark.createDataFrame([(1, "<p>ok</p>"), (2, "&amp;lt;p&amp;gt;x&amp;lt;/p&amp;gt;"), (3, "<p>a</p><script>b</script>"), (4, ""), (5, None)], "k long, html string")
    assert sorted(tuple(r) for r in markup.resanitized(df, "k", "html").collect()) == [(2, "<p>x</p>"), (3, "<p>a</p>")]
