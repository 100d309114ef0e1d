"""Page rows against a plain tree walk, selectors on siblings, and the plans' shapes."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import arrays as A
from pageloom.operators import css, dedup, dom, pagerow as R, treepass
from pageloom.operators.treepass import TreeSpec
from pageloom.plans import content as C
from pageloom.plans import selective as S
from pageloom.profiles import ArraySpec, SelectiveSpec

LIST = """<div id=top><h1>T</h1><p>a</p><ul><li>1</li><li class=x>2</li><li>3</li><li class="x y">4</li><li>5</li></ul>
<p class=x>b</p><!-- c --><p></p><span> </span><em><i>only</i></em></div>"""


def found(html, selector):
    nodes = dom.tree(html)
    return [i for i, m in enumerate(treepass.marks(nodes, (css.parse(selector),))) if m], nodes


def label(html, selector):
    hit, nodes = found(html, selector)
    return ["".join(n[treepass.TEXT] for n in nodes[i: nodes[i][treepass.POST] + 1] if n[treepass.KIND] == "text") for i in hit]


@pytest.mark.parametrize("selector,want", [
    ("li:nth-child(2)", ["2"]), ("li:nth-child(odd)", ["1", "3", "5"]), ("li:nth-child(even)", ["2", "4"]),
    ("li:nth-child(3n+2)", ["2", "5"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:nth-last-child(2)", ["4"]),
    ("li:first-child", ["1"]), ("li:last-child", ["5"]), ("h1 + p", ["a"]), ("h1 ~ p", ["a", "b", ""]), ("p + ul > li.x + li", ["3", "5"]),
    ("ul ~ p.x", ["b"]), ("p:first-of-type", ["a"]), ("p:nth-of-type(2)", ["b"]), ("p:last-of-type", [""]), ("i:only-child", ["only"]),
    ("em:only-of-type", ["only"]), ("p:empty, span:empty", ["", " "]), ("li:not(.x)", ["1", "3", "5"]), ("li:is(.y, :first-child)", ["1", "4"]),
    ("div:root > h1", ["T"]), ("li:nth-child(n)", ["1", "2", "3", "4", "5"]), ("li:nth-child(7)", []), ("ul li ~ li.y", ["4"]),
])
def test_sibling_selectors(selector, want):
    assert label(LIST, selector) == want


@pytest.mark.parametrize("bad", ["li:nth-child()", "li:nth-child(x)", "p:hover(2)", ":not()", "+ p", "h1 + > p", "p:first-child(2)"])
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.parse(bad)


def plain_match(nodes, i, parts, combs):
    """Right to left with backtracking over parents and siblings."""
    def fits(i, c):
        n = nodes[i]
        return n[2] == "elem" and c.tag in (None, "*", n[3]) and all(x in n[4].get("class", "").split() for x in c.classes)
    if not fits(i, parts[-1]):
        return False
    if len(parts) == 1:
        return True
    before = [j for j in range(i) if nodes[j][0] == nodes[i][0] and nodes[j][2] == "elem"]
    ups = []
    j = nodes[i][0]
    while j >= 0:
        ups.append(j)
        j = nodes[j][0]
    near = {">": ups[:1], " ": ups, "+": before[-1:], "~": before}[combs[-1]]
    return any(plain_match(nodes, j, parts[:-1], combs[:-1]) for j in near)


def random_page(r, depth=0):
    out = []
    for _ in range(r.randint(0, 4)):
        if depth > 4 or r.random() < 0.3:
            out.append(r.choice(["word", " two words ", "\n", "<br>", "<!--note-->", "<img alt='pic of it'>"]))
        else:
            t = r.choice(["div", "p", "a", "b", "li", "section"])
            out.append(f"<{t} class='{r.choice(['x', 'y', 'x y', ''])}'>{random_page(r, depth + 1)}</{t}>")
    return "".join(out)


def test_marks_against_backtracking():
    r = random.Random(5)
    for _ in range(60):
        nodes = dom.tree(random_page(r) + random_page(r))
        raw = " ".join(r.choice(["div", "p", ".x", "*", "a.y"]) + r.choice(["", " >", " +", " ~"]) for _ in range(r.randint(1, 3)))
        raw = raw.rstrip(" >+~")
        sel = css.parse(raw)
        cx = sel.alternatives[0]
        want = [int(plain_match(nodes, i, cx.parts, cx.combinators)) for i in range(len(nodes))]
        assert treepass.marks(nodes, (sel,)) == want, raw


class Node:
    def __init__(self, kind, tag=None, text=None, attrs=None):
        self.kind, self.tag, self.text, self.attrs, self.kids = kind, tag, text, attrs, []


def plain_tree(html):
    nodes = dom.tree(html)
    made = [Node(n[2], n[3], n[5], n[4]) for n in nodes]
    top = Node("doc")
    for n, m in zip(nodes, made, strict=True):
        (made[n[0]] if n[0] >= 0 else top).kids.append(m)
    return top


def string(n):
    if n.kind != "elem" and n.kind != "doc":
        return n
    return string(n.kids[0]) if len(n.kids) == 1 else None


def plain_clean(n):
    """Drop tags and images, unwrap links, on real objects."""
    def drop(n):
        n.kids = [k for k in n.kids if k.tag not in (*R.REMOVE_TAGS, "img")]
        for k in n.kids:
            drop(k)

    def unwrap(n):
        out = []
        for k in n.kids:
            if k.tag != "a":
                unwrap(k)
                out.append(k)
            elif (s := string(k)) is not None:
                out.append(Node("text", text=s.text if s.kind == "text" else ""))
            else:
                unwrap(k)
                out += k.kids
        n.kids = out

    drop(n)
    unwrap(n)
    return n


def strings(n):
    return [n.text] if n.kind == "text" else [t for k in n.kids for t in strings(k)]


def plain_blocks(n):
    out = []
    for k in n.kids:
        if k.kind == "elem":
            block = "".join(t.strip() for t in strings(k))
            if k.tag in R.BLOCK_TAGS and block:
                out.append(block)
            elif (s := string(k)) is not None and s.text.strip():
                out.append(s.text.strip())
            out += plain_blocks(k)
        elif k.text.strip():
            out.append(k.text.strip())
    return out


def test_block_text_against_a_tree_walk(spark):
    r = random.Random(11)
    html = [random_page(r) + random_page(r) for _ in range(120)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    got = {x["page_id"]: x["content"] for x in C.content_text(df).collect()}
    for i, h in enumerate(html):
        assert got[i] == " ".join(" ".join(plain_blocks(plain_clean(plain_tree(h)))).split()), h


def test_element_text_of_links(spark):
    html = "<div class=it>see <a href=1>this <b>bold</b> one</a> and <a href=2>an<a href=3>other</a></a><img alt='a picture'></div><a href=9><div class=it>x <i>y</i></div></a>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    spec = TreeSpec(select=(css.parse(".it"),), image_alt=4)
    got = R.page_rows(df, spec).select(F.explode(R.element_texts(R.hits(0), False)).alias("t")).collect()
    assert [r["t"] for r in got] == ["see thisboldone and another [Image: a picture]", "x y"]


def test_bad_page_is_a_row(spark, monkeypatch):
    spec = TreeSpec()
    good = R._page("<p>x</p>", spec)
    assert good["failure"] is None and good["s"] == ["x"]
    monkeypatch.setattr(R.treepass, "clean", lambda *a: 1 / 0)
    bad = R._page("<p>x</p>", spec)
    assert bad["failure"].startswith("ZeroDivisionError") and bad["failed_html"] == "<p>x</p>" and bad["post"] == []


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_one_scan_and_no_exchange(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    spec = SelectiveSpec(("article", ".ad", "h1"), (".none",), 5000)
    items = [ArraySpec("p", "article p", (("title", "b"), ("link", "a"), ("image", "img"))), ArraySpec("li", "li", (), 3)]
    for df in (C.content_only(pages), C.content_text(pages), S.selective(pages, spec), A.array_pages(pages, items),
               A.array_items(pages, items)):
        assert (scans(df), exchanges(df)) == (1, 0)


def test_keep_first_folds_against_plain_loops():
    r = random.Random(3)
    words = ["blue", "bolt", "large", "pack", "red", "widget", "small", "green", "nut", "steel", "copper"]
    for _ in range(40):
        items = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 30))]
        items += [r.choice(items) for _ in range(3)] if items else []
        norms, kept = [t.strip().lower() for t in items], []
        for j, t in enumerate(norms):
            if len(items) > 1 and len(t) < 20:
                continue
            if not any(t == norms[i] or difflib.SequenceMatcher(None, t, norms[i]).ratio() > 0.75 for i in kept):
                kept.append(j)
        assert dedup.kept_item_places(items) == (kept if len(items) > 1 else list(range(len(items))))


def plain_e4(text):
    blocks = dedup._split_blocks_py(text)
    kept = []
    for raw in blocks:
        b = dedup._norm_py(raw)
        if len(b) < 15 or any(b in k and len(b) > len(k) * 0.7 for k, _ in kept):
            continue
        kept = [(k, x) for k, x in kept if not (k in b and len(k) > len(b) * 0.7)] + [(b, raw)]
    return "\n\n".join(x for _, x in kept) if kept else text


def test_block_containment_against_plain_loop():
    r = random.Random(8)
    for _ in range(60):
        base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "pi"]) for _ in range(r.randint(2, 40))) for _ in range(8)]
        blocks = [x[r.randint(0, 5): len(x) - r.randint(0, len(x) // 2)] if r.random() < 0.6 else x for x in r.choices(base, k=30)]
        text = "\n\n".join(blocks)
        assert dedup.dedup_blocks_py(text) == plain_e4(text)


def test_many_blocks_are_linear():
    text = "\n\n".join(f"block number {i} says {i * 7919 % 100003} and ends with {i * 31 % 997}" for i in range(50_000))
    assert dedup.dedup_blocks_py(text).count("\n\n") == 49_999


def test_more_than_five_arrays_raise():
    with pytest.raises(ValueError, match="5"):
        A.check_specs([ArraySpec(str(i), "p") for i in range(6)])
