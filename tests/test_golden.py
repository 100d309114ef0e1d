"""Golden pages F-1..F-9 and scalar goldens (hand-derived expected values)."""

from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.functions import urls as U
from pageloom.operators import arrays as A
from pageloom.operators import dedup as E
from pageloom.operators import css, pagerow as R
from pageloom.operators.treepass import TreeSpec
from pageloom.plans import content as C
from pageloom.plans import selective as S
from pageloom.profiles import ArraySpec, SelectiveSpec

F1 = '<html><head><title> T1 </title></head><body><nav>menu</nav><main><div><p>one</p><p>two</p></div></main><footer>foot</footer></body></html>'
F2 = '<body><article><h1>H</h1><p><b>Lead<br><p>Second</p></article></body>'
F3 = '<body><main><!-- ad 7 --><p>Text</p><script>var t="</p>";</script></main></body>'
F4 = '<body><main><p>See <a href="/x"><b>this</b></a> and <a href="/y">that <i>one</i></a>.</p></main></body>'
F5 = ('<body><div id="top" class="lead">Cats sleep in warm places all day. They wake up at dusk to hunt.</div>\n'
      '<div class="more">Our library opens at nine on weekdays and closes late. Visitors should bring a valid card with them.</div>\n'
      '<p class="ads">Buy now!</p></body>')
F6 = '<body><main>The quick brown fox jumps over. The quick brown fox jumps over it.</main></body>'
F7 = ('<ul>\n<li class="it"><h2><a href="/p/1">Blue bolt, large pack</a></h2><img data-src="img/1.jpg" alt="Blue bolt"><span class="tag">new</span><span class="tag">sale</span></li>\n'
      '<li class="it"><h2><a href="../p/2">Red widget, small pack</a></h2><img src="//cdn.example.com/2.jpg" alt="x"></li>\n'
      '<li class="it">tiny</li>\n'
      '<li class="it"><h2><a href="/p/1">Blue bolt, large pack</a></h2><img data-src="img/1.jpg" alt="Blue bolt"><span class="tag">new</span><span class="tag">sale</span></li>\n</ul>')
BASE = "https://shop.example.com/list/index.html"


def pages(spark, *htmls):
    return spark.createDataFrame([(i + 1, BASE, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def by_page(rows, col):
    return {r["page_id"]: r[col] for r in rows}


def test_content_only_faithful(spark):
    df = pages(spark, F1, F2, F3, F4)
    got = by_page(C.content_text(df).collect(), "content")
    assert got == {1: "onetwo one one two two", 2: "H H LeadSecond Lead Second Second", 3: "ad 7 Text Text",
                   4: "Seethisandthatone. See this and that one one ."}


def texts(df, spec, bit, sentences):
    rows = R.page_rows(df, spec)
    return {r["page_id"]: r["t"] for r in rows.select("page_id", F.explode(R.element_texts(R.hits(bit), sentences)).alias("t")).collect()}


def counts(df, *selectors):
    rows = R.page_rows(df, R.content_spec((), [css.parse(s) for s in selectors]))
    return {r["page_id"]: tuple(r)[1:] for r in rows.select("page_id", *[F.size(R.hits(13 + i)) for i in range(len(selectors))]).collect()}


def test_title_and_element_text(spark):
    df = pages(spark, F1, F2, F3, F4)
    assert by_page(R.page_rows(df, TreeSpec()).select("page_id", R.title_text().alias("title")).collect(), "title") == \
        {1: "T1", 2: "", 3: "", 4: ""}
    main = css.parse("main, article")
    assert texts(df, R.content_spec((), [main]), 13, True) == {1: "one two", 2: "H Lead Second", 3: "Text", 4: "See this and that one ."}
    arr = TreeSpec(remove=tuple(R.ARRAY_REMOVE_TAGS), select=(css.parse("main"),), image_alt=4)
    assert texts(df, arr, 0, False)[4] == "See this and thatone ."


def test_selector_counts_after_unwrap(spark):
    got = counts(pages(spark, F2, F4), "article > p", "article p", "b", "i")
    assert got[1][:2] == (1, 2) and got[2][2:] == (0, 1)


def test_sections_f5(spark):
    r = S.selective(pages(spark, F5), SelectiveSpec((".more", "#top", ".none"), (".ads",))).collect()[0]
    assert r["selectors_used"] == ["selector_1_.more", "selector_2_#top"]
    assert r["total_sections"] == 2 and r["deduplication_applied"] is True and r["selectors_provided"] == 3
    assert r["content"] == ("[.more]\nOur library opens at nine on weekdays and closes late\n\n"
                            "Visitors should bring a valid card with them\n\n[#top]\nCats sleep in warm places all day"
                            "\n\nThey wake up at dusk to hunt")
    fb = S.selective(pages(spark, F5), SelectiveSpec((".none",), ())).collect()[0]
    assert fb["selectors_used"] == ["fallback"]


def test_supersede_f6(spark):
    df = pages(spark, F6)
    r = S.selective(df, SelectiveSpec((), ())).collect()[0]
    assert r["content"] == "The quick brown fox jumps over it"
    f = S.selective(df, SelectiveSpec((), ()), on_supersede="fallback").collect()[0]
    assert f["extraction_method"] == "fallback_regex"
    assert f["content"] == "The quick brown fox jumps over. The quick brown fox jumps over it."


def test_array_f7(spark):
    spec = ArraySpec("items", ".it", (("title", "h2"), ("image", "img"), ("link", "a"), ("tag", ".tag")))
    df = pages(spark, F7)
    it = A.absolutize(A.array_items(df, [spec]), [spec])
    rows = sorted(it.collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == [0, 1]
    assert rows[0]["main_content"] == "Blue bolt, large pack [Image: Blue bolt] new sale"
    assert (rows[0]["word_count"], rows[0]["char_count"]) == (9, 49)
    assert rows[1]["main_content"] == "Red widget, small pack"
    f0, f1 = rows[0]["fields"], rows[1]["fields"]
    assert f0["image"] == ["https://shop.example.com/list/img/1.jpg"] and f0["link"] == ["https://shop.example.com/p/1"]
    assert f0["tag"] == ["new", "sale"] and f1["tag"] == [""]
    assert f1["image"] == ["https://cdn.example.com/2.jpg"] and f1["link"] == ["https://shop.example.com/p/2"]


def test_single_and_short_items(spark):
    spec = ArraySpec("items", ".it", ())
    f8 = '<ul><li class="it">x</li><li class="it">exactly sixteen!</li></ul>'
    f9 = '<ul><li class="it">exactly sixteen!</li><li class="it">another short one</li></ul>'
    it = A.array_items(pages(spark, f8, f9), [spec]).collect()
    assert [(r["page_id"], r["index"]) for r in it] == [(1, 1)]


def test_scalar_goldens(spark):
    rels = ["img/1.jpg", "/p/1", "../p/2", "?page=2", "#top", "", "HTTP://x.org/a", "mailto:a@b.c", "//cdn.example.com/2.jpg"]
    df = spark.createDataFrame([(r,) for r in rels], "r string").select("r", U.absolute_url(F.lit(BASE), F.col("r")).alias("o"))
    got = {x["r"]: x["o"] for x in df.collect()}
    assert got["img/1.jpg"] == "https://shop.example.com/list/img/1.jpg"
    assert got["../p/2"] == "https://shop.example.com/p/2"
    assert got["?page=2"] == "https://shop.example.com/list/index.html?page=2"
    assert got["#top"] == "https://shop.example.com/list/index.html#top"
    assert got[""] == "" and got["HTTP://x.org/a"] == "HTTP://x.org/a" and got["mailto:a@b.c"] == "mailto:a@b.c"
    assert got["//cdn.example.com/2.jpg"] == "https://cdn.example.com/2.jpg"
    ok = ["https://a.com/x", "ftp://a", "https://ä.com/x", " https://a.com"]
    bad = ["a.com", "http://", "//a.com/x", "mailto:a@b.c", "http:///p", "http://[", "1http://a"]
    v = spark.createDataFrame([(u,) for u in ok + bad], "u string").select("u", U.validate_url("u").alias("v")).collect()
    assert {x["u"]: x["v"] for x in v} == {**{u: True for u in ok}, **{u: False for u in bad}}
    one = spark.range(1).select(
        X.truncate(F.lit("abcdef"), 3).alias("a"), X.truncate(F.lit("abcdef"), 3, ellipsis=False).alias("b"),
        X.word_count(F.lit("")).alias("w0"), X.word_count(F.lit(" a  b\nc ")).alias("w3"),
        X.dedup_sentences(F.lit("Same words go here. Same words go here. Other words go there.")).alias("e1"),
        X.content_analysis(F.lit("The cats saw the CATS today")).alias("g4"),
        U.with_scheme(F.lit("example.com")).alias("s")).collect()[0]
    assert (one["a"], one["b"], one["w0"], one["w3"]) == ("abc...", "abc", 0, 3)
    assert one["e1"] == "Same words go here. Other words go there."
    assert (one["g4"]["total_words"], one["g4"]["unique_words"], one["g4"]["vocabulary_ratio"]) == (6, 2, 0.333)
    assert one["s"] == "https://example.com"


def test_ratio():
    assert round(E.seq_ratio_py("the quick brown fox jumps over the lazy dog",
                                "the quick brown fox jumped over the lazy dog"), 4) == 0.9655
    assert E.seq_ratio_py("tide", "diet") == 0.25 and E.seq_ratio_py("diet", "tide") == 0.5


def test_dedup_blocks_fold(spark):
    df = spark.createDataFrame([("First sentence of this page. Second sentence of this page.",)], "t string")
    assert df.select(E.dedup_blocks(F.col("t")).alias("d")).collect()[0]["d"] == \
        "First sentence of this page\n\nSecond sentence of this page"
