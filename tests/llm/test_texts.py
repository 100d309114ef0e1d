"""Personal data, pieces, packing, pages and neighbours against plain code."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pageloom.llm import packing, pieces, pii, rabitq, render

from .conftest import DOCS, odd_documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def pii_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab@.-+ ()1234567890%_\n é\U0001F600") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    return made + ["a@b." + "c." * 4000 + "c", "1.1.1.1" * 200, " ".join(["+1 (988) 555-2485"] * 200), "4041894974608795 " * 150,
                   "a@b.co_x@y.z", ".@a.b", "a" * 3000, "1" * 20_000, "+1" + "(" * 20_000, "000255.0.0.001", "256.1.1.1",
                   "1.2.3.4.5.6.7.8", "é a@b.c \U0001F600 +1234567890"]


def test_base_spans(table):
    rows = list(enumerate(pii_texts())) + [(None, None), (7, "a@b.cc"), (7, "a@b.cc")]
    got = pii.personal_data(table(rows, "doc_id long, text string")).collect()
    want = collections.Counter()
    for k, t in rows:
        b = base_spans(t or "")
        n = collections.Counter(x[3] for x in b)
        digest = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in b)
        want[(k, *(n[x] for x, _ in KINDS), hashlib.sha256(digest.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want


def test_context_discovers_unseen_identifiers(table):
    rows = [(i, f"please write to user{i}@example.com today and ask") for i in range(30)]
    rows += [(100 + i, f"please write to KXQ{i:04d}ZZ91A{i:03d} today and ask") for i in range(5)]
    rows += [(200 + i, f"version BUILD{i:04d}XY77 of module number {i}") for i in range(30)]
    docs = table(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert all(got[100 + i] == f"context:16:{16 + 15}" for i in range(5))
    assert all(got[200 + i] == "" for i in range(30))
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[3] == "please write to [EMAIL] today and ask" and red[101] == "please write to [CONTEXT] today and ask"
    assert red[205] == rows[40][1]


def test_context_finds_any_shape(table):
    """Identifiers of five shapes in the context of seeds; the same shapes elsewhere stay."""
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    shapes = [lambda: f"KXQ{digits(6)}ZZ", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"AB-{digits(5)}-{digits(4)}",
              lambda: digits(9), lambda: f"PX{digits(5)}"]
    rows = [(i, f"my record is user{i}@example.com on file") for i in range(60)]
    rows += [(100 + 20 * k + i, f"my record is {shape()} on file") for k, shape in enumerate(shapes) for i in range(20)]
    rows += [(500 + 20 * k + i, f"we sold {shape()} units") for k, shape in enumerate(shapes) for i in range(20)]
    rows += [(900, "in 2024 and 1999 a/b/c and 12 or x-y-z 3.5 stay")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(table(rows, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("context:13:") for i in range(100, 200))
    assert all(got[i] == "" for i in range(500, 600)) and got[900] == ""


def plain_redact(text, spans):
    out, at = "", 0
    for s, _, e, kind in sorted(spans):
        if s >= at:
            out, at = out + text[at:s] + f"[{kind.upper()}]", e
        else:
            at = max(at, e)
    return out + text[at:]


def test_redact_against_plain_loop(table, monkeypatch):
    r = random.Random(9)
    bits = ["jo.doe@example.com", "+1 (988) 555-2485", "10.0.0.1", "4041894974608795", "+1 4041894974608795 1", "10.1.2.3.4.5", "é", " ", "word ", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(100, "10.0.0.1 " * 3000)]
    docs = table(rows, "doc_id long, text string")
    rank = {k: i for i, k in enumerate((*pii.KINDS, pii.CONTEXT))}
    spans = {x["doc_id"]: [(int(s), rank[k], int(e), k) for k, s, e in (y.split(":") for y in x["spans"].split(",") if y)]
             for x in pii.personal_data(docs).collect()}
    monkeypatch.setattr(pii, "CUT", 7)
    got = {x["doc_id"]: x["text"] for x in pii.redact(docs.where("doc_id < 100")).collect()}
    assert all(got[i] == plain_redact(t, spans[i]) for i, t in rows[:-1])
    monkeypatch.setattr(pii, "CUT", 4096)
    assert pii.redact(docs.where("doc_id = 100")).first()["text"] == "[IP] " * 3000


def test_redact_columns_of_any_name(table):
    names = ("_row", "_base", "_t", "_found", "_other", "_more", "row", "blocks", "marks")
    docs = table([(1, "mail jo@example.com", None)], "doc_id long, text string, x string")
    for n in names:
        docs = docs.withColumn(n, pii.F.lit(5))
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert got.first().asDict() == {"doc_id": 1, "text": "mail [EMAIL]", "x": None, **{n: 5 for n in names}}


def test_many_spans_in_one_text(table):
    text = "10.0.0.1 ab-123-x " * 20_000
    got = pii.personal_data(table([(1, text)], "doc_id long, text string")).first()
    assert got["n_ip"] == 20_000


def test_pii_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.personal_data(none).count() == 0 and pii.redact(none).count() == 0


def test_pieces(table, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = [(400 + i, t, "", "", 0) for i, t in enumerate(["▁x ▁", " " * 60, "a\x00b", "<s> </s>", "ab" * 200])]
    docs = table(odd_documents() + odd, DOCS).unionByName(documents)
    plain = {(r["doc_id"], r["text"]): None for r in docs.collect()}
    for dropout in (0.0, 0.2):
        out = pieces.encode(docs, PIECES, dropout)
        rows = out.collect()
        assert all(r["lossless"] or r["ids"] is None for r in rows)
        texts = sorted(pieces.decode(out, PIECES).collect(), key=str)
        assert texts == sorted(docs.select("doc_id", "text").collect(), key=str)
        if not dropout:
            want = sorted((str(k), sp.encode(t)) for k, t in plain if t is not None and "▁" not in t)
            have = {(str(r["doc_id"]), tuple(r["ids"])) for r in rows if r["ids"] is not None}
            assert all((k, tuple(i)) in have for k, i in want)
    again = pieces.encode(docs.repartition(5), PIECES, 0.2).collect()
    assert sorted(again, key=str) == sorted(rows, key=str)
    assert any(a["ids"] != b["ids"] for a, b in zip(
        sorted(again, key=str), sorted(pieces.encode(docs, PIECES, 0.2, seed=1).collect(), key=str)))


def test_empty_tables_of_pieces_and_pages(spark):
    none = spark.createDataFrame([], DOCS)
    assert pieces.encode(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert render.render_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lossless_flags_a_wrong_text():
    enc = pieces._encoder(pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model")), 0.1, 17)
    texts = pa.array(["two words", "", None, "naïve ▁ \n end ", "x"])
    (row, ids, offs), = list(enc.encode(texts, np.arange(5).astype(np.uint64)))
    assert enc.lossless(ids, offs, texts).all()
    other = pa.array(["two wordz", "", "a", "naïve ▁ \n end ", "xy"])
    assert enc.lossless(ids, offs, other).tolist() == [False, True, False, True, False]


def test_places():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**50, 5000))
    np.random.default_rng(3).shuffle(keys)
    places = pieces.Places(keys)
    assert np.array_equal(places.find(keys), np.arange(keys.size))
    other = np.setdiff1d(keys + 1, keys)
    assert (places.find(other) == -1).all() and places.find(np.array([-1, -2])).tolist() == [-1, -1]


def test_agenda_equals_arrays():
    one, many = pieces.Encoder(pieces.load_pieces(PIECES), 0.3), pieces.Arrays(pieces.load_pieces(PIECES), 0.3)
    for word in "the weather unbelievable thonwhre naïve 你好x aaaaaaaa internationalization".split():
        for v in range(4):
            b = (" " + word).encode()
            ids, _ = many.segment_all(b, np.array([0]), np.array([len(b)]), np.array([v]))
            assert ids.tolist() == one.segment(pieces.BLANK + word, v)


def test_every_occurrence_draws_its_own_skips(table):
    """Equal to the priority queue run per occurrence, and not held to a few segmentations a word."""
    tables = pieces.load_pieces(PIECES)
    one = pieces.Encoder(tables, 0.3)
    words = ["unbelievable"] * 400 + ["the", "naïve", "你好x", "a▁bab▁bab"] * 20 + ["internationalization" * 5] * 20
    col, doc_ids = pa.array([" ".join(words), None, "the the the"]), np.array([7, 8, 9], dtype=np.uint64)
    [(_, ids, offs)] = pieces.Arrays(tables, 0.3).encode(col, doc_ids)
    want, seen = [], collections.Counter()
    for ident, text in ((7, words), (9, ["the"] * 3)):
        for k, word in enumerate(text):
            draw = (k + ident * int(pieces._PIECE)) % 2**64
            got, at = [], 0
            for j, part in enumerate((" " + word).split(pieces.BLANK)):
                got += [one.bytes[b] for b in pieces.BLANK.encode()] if j else []
                got += one.segment(part.replace(" ", pieces.BLANK), draw, at)
                at += len(part) + 1
            want += got
            seen[word, tuple(got)] += 1
    assert ids.tolist() == want
    assert sum(w == "unbelievable" for w, _ in seen) > 20
    assert sum(w.startswith("internationalization") for w, _ in seen) > 4


def check_packing(docs, capacity):
    tok = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[(r["doc_id"], k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))] += 1
    rows = packing.best_fit_packing(docs, BPE, capacity).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(k[3] * c for k, c in want.items()) // capacity)


def test_packing(documents, table, spark):
    used, bound = check_packing(documents, 1024)
    assert used <= bound + 3
    check_packing(table(odd_documents(), DOCS), 128)
    assert packing.best_fit_packing(spark.createDataFrame([], DOCS), BPE).count() == 0


def test_genetic_operators():
    rng = random.Random(1)
    lens = [rng.randint(200, 600) for _ in range(300)]
    a, b = packing.decreasing(lens, 1024, rng), packing.decreasing(lens, 1024, rng)
    for x in (packing.crossover(a, b, rng), packing.mutate(a, rng), packing.unpack(packing.pack_array(a), lens, 1024)):
        assert sorted(i for items in x.items for i in items) == list(range(300))
        assert all(sum(lens[i] for i in items) == 1024 - s >= 0 for items, s in zip(x.items, x.space))
    best = packing.evolve(lens, 1024, 3, children=40)
    assert best.fitness() >= packing.decreasing(lens, 1024).fitness()


@pytest.mark.parametrize("html,text", [
    ("<ul><li>one<li>two <b>b</b>c<ul><li>in</ul><li>three</ul>after", "- one\n- two bc\n  - in\n- three\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>long name<td>12<br>x</table>t",
     "Name       Qty\nApple      3\nlong name  12\n           x\n\nt"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide", "a     b\n      c\nwide"),
    ("<p>a<p>b<div>c</div>d<br>e<pre>\n x\n  y</pre>", "a\n\nb\n\nc\nd\ne\n\n x\n  y"),
    ("<ol start=3><li>t<li value=9>n<li>m</ol>", "3. t\n9. n\n10. m"),
    ("<head><title>no</title></head><div hidden>no</div><p style='display:none'>no</p><script>if(a<b)</script>yes<!-- no -->", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<details><summary>S</summary>no</details><select><option>1<option selected>2</select>", "S\n2"),
    ("a &amp; &copy; b</x></p>c", "a & © b\n\nc"), ("<div>" * 20_000 + "deep", "deep"), ("<a title='x>y'>t</a><p title=it's>z", "t\n\nz"),
    ("", ""), ("   \n ", ""), ("<b", ""), ("1 < 2 <3", "1 < 2 <3"),
])
def test_render(html, text):
    assert render.render(html) == text


@pytest.mark.parametrize("html,text", [
    ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><meta charset=x>\n Hello <b>you</b>", "Hello you"),
    ("<head><style>no</style><script>no</script>\n<link rel=x></head>\n<body>yes", "yes"),
    ("<head><title>T</title><div>a</div><body><p>b", "a\n\nb"), ("<head><title>T</title></head>x<head>y", "xy"),
    ("<head><template><p>no</p></template><p>yes", "yes"), ("<head><noscript><p>no</p></noscript><p>yes", "yes"),
    ("<table><colgroup><col><tr><td>x</table>y", "x\n\ny"), ("<table><colgroup><col><tbody><tr><td>x</table>", "x"),
    ("<table><caption>c<colgroup><col><colgroup><col><thead><tr><th>h<tbody><tr><td>x</table>", "c\nh\nx"),
    ("<div>a<svg/>b</div>", "ab"), ("<div>a<math/>b</div>c", "ab\nc"), ("<div>a<div/>b</div>", "a\nb"),
    ("<svg><title>no</title><defs><text>no</text></defs><path d='x'/><text>yes</text></svg> t", "yes t"),
    ("<p>is <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.", "is x=2."), ("a <map name=m><area><p>in</p></map>", "a\n\nin"),
    ("<filter>a</filter><svg><filter>no</filter><foreignObject><div/>b</foreignObject></svg>c", "a\nb\nc"),
    ("<svg><defs><p>yes", "yes"), ("<svg><a href=x/>t</a><defs/>u</svg>", "tu"),
    ("<svg><style>no</style><script>no</script><text x='1'>t</text></svg>", "t"),
])
def test_render_optional_tags_and_foreign_elements(html, text):
    assert render.render(html) == text


def test_render_pages(spark, table):
    rows = [(1, None, 5), (2, "<p>x", 6), (2, "<p>x", 6), (None, "<i>y</i>", 7), (3, "<p>word " * 50_000, 8)]
    got = render.render_pages(table(rows, "page_id long, html string, text int")).collect()
    assert sorted((str(r["page_id"]), r["text"][:4], r["n_lines"]) for r in got) == [
        ("1", "", 0), ("2", "x", 1), ("2", "x", 1), ("3", "word", 99_999), ("None", "y", 1)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    text = {r["page_id"]: r["text"] for r in render.render_pages(pages).collect()}
    for r in pages.collect():
        assert "track(" not in text[r["page_id"]] and "margin" not in text[r["page_id"]]
        for item in re.findall(r"<li><a [^>]*>([^<&]+)</a></li>", r["html"]):
            assert f"- {item}" in text[r["page_id"]].split("\n")


def brute_neighbours(rows, every, k):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
          and len(v) == 16]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = [(-round(float((x * q).sum() / np.sqrt((x * x).sum()) / np.sqrt((q * q).sum())), 12), j) for j, x in ok if j != i]
            out[i] = [j for _, j in sorted(s)[:k]]
    return out


def test_neighbours(table, spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 64)
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[20][1]) for i in range(300)]           # one very common vector
    rows += [(3000, None), (3010, [0.0] * 16), (3020, [1.0, None] * 8), (3030, [float("nan")] * 16), (3040, [1.0, 2.0]), (None, rows[3][1]),
             (3050, [float("inf")] * 16), (3060, [])]
    got = collections.defaultdict(list)
    for r in sorted(rabitq.neighbours(table(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell"), 5, 10).collect(),
                    key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    want = brute_neighbours(rows, 10, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) > 0.97
    assert got[20] == [2000, 2001, 2002, 2003, 2004] and got[2000][0] == 20
    few = rabitq.neighbours(table([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"), 5, 50)
    assert [(r["vec_id"], r["rank"]) for r in sorted(few.collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert rabitq.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("tiny", [[1e-200, 2e-200], [5e-324, 0.0], [1e308, -1e308]])
def test_extreme_vectors_do_no_harm(table, tiny):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(2).tolist()) for i in range(200)] + [(200, tiny)]
    got = rabitq.neighbours(table(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 5 * 5 and all(np.isfinite(x["score"]) for x in got)        # 0, 50, 100, 150 and 200 ask
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    best = np.sort(np.delete(x @ x[200], 200))[::-1][:5]
    assert np.allclose(sorted((g["score"] for g in got if g["query_id"] == 200), reverse=True), best)


def test_one_bit_bound_holds():
    rng = np.random.default_rng(1)
    x = rabitq.unit(rng.standard_normal((2000, 64)))
    c = rabitq.unit(rng.standard_normal((1, 64)))
    rot = rabitq.rotation(64)
    _, code, norm, along, prod = rabitq.encode(x, c, rot)
    q = rabitq.unit(x[7:9] + 0.2 * rng.standard_normal((2, 64)))
    est, err = rabitq.estimate(rabitq.words64(code), norm, along, prod, q, c[0], rot)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.99
    assert np.corrcoef(est[0], x @ q[0])[0, 1] > 0.5
