"""Faults once found, each with the input that showed it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import arrays as A
from pageloom.operators import dedup as E, dom, neardup as ND, stats, windows as W
from pageloom.plans import content as C
from pageloom.plans import envelopes as V
from pageloom.plans import selective as S
from pageloom.plans.registry import QUERIES
from pageloom.profiles import ArraySpec, SelectiveSpec
from pageloom.sources import pages as P
from pageloom.streaming import streams as ST

PAGE = "<html><head><title>T</title></head><body><main><h1>Head line</h1><p>Some words are here.</p></main></body></html>"


def pages(spark, *html):
    return spark.createDataFrame([(i, f"https://a.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_deep_pages_keep_their_tree():
    rows = dom.parse_html("<section>" + "<b>" * 600 + "<section>inner</section>tail")
    tail = next(r for r in rows if r["text"] == "tail")
    assert tail["depth"] == 601 and len(tail["anc"]) == 601
    assert tail["parent"] == 600 and rows[0]["post"] == len(rows) - 1
    assert next(r for r in rows if r["text"] == "inner")["depth"] == 602


def test_deep_page_spans_batches(spark):
    nodes = dom.explode_nodes(pages(spark, "<p>x" * 900))
    assert nodes.agg(F.max("depth"), F.count(F.lit(1)), F.max(F.size("anc"))).first()[:] == (900, 1800, 900)


def test_failures_are_failures(spark):
    df = pages(spark, PAGE, None).withColumn("success", F.col("page_id") < 9)
    for out in (C.content_only(df), S.selective(df, SelectiveSpec(("main",)))):
        got = {r["page_id"]: r for r in out.collect()}
        assert got[0]["success"] and got[0]["error"] is None and "Some words" in got[0]["content"]
        assert not got[1]["success"] and got[1]["error"] == P.MSG_NO_HTML and got[1]["content"] == ""
    down = df.withColumn("success", F.lit(False)).withColumn("error_message", F.lit("timeout"))
    assert {r["error"] for r in C.content_only(down).collect()} == {"timeout"}


def test_cleaned_html_is_read(spark):
    df = pages(spark, None).withColumn("cleaned_html", F.lit(PAGE))
    assert C.content_only(df).first()["success"]


def test_repeated_selector_keeps_its_place(spark):
    rows = S.section_rows(pages(spark, PAGE), ["h1", "p[", "h1"])
    got = sorted((r["sel_pos"], r["section_key"]) for r in S.sections(rows).collect())
    assert got == [(0, "selector_1_h1"), (2, "selector_3_h1")]


def test_sections_on_request(spark):
    spec = SelectiveSpec(("h1", "p"), return_sections=True)
    got = S.selective(pages(spark, PAGE), spec).first()["sections"]
    assert got["selector_1_h1"]["content"] == "Head line" and set(got) == {"selector_1_h1", "selector_2_p"}


def test_items_count_from_one(spark):
    html = "<ul><li class='it'>x</li><li class='it'>exactly sixteen!</li></ul>"
    specs = [ArraySpec("news", ".it", (("b", "b"), ("a", "a")))]
    p = pages(spark, html)
    rows = A.array_pages(p, specs)
    assert A.item_rows(rows).first()["index"] == 1
    text = rows.select(A.format_structured().alias("content")).first()["content"]
    assert "[Item 1]" in text and "[Item 2]" not in text


def test_dedup_flag_without_a_second_frame(spark):
    one = "<li class='it'>the very same sentence twice</li>"
    specs = [ArraySpec("news", ".it")]
    for html, flag in ((one * 2, True), (one, False)):
        assert A.array_summary(A.array_pages(pages(spark, html), specs)).first()["deduplication_applied"] is flag


def test_sub_fields_keep_the_order_of_their_array(spark):
    specs = [ArraySpec("one", ".a", (("x", "b"), ("y", "i"))), ArraySpec("two", ".c", (("y", "i"), ("x", "b")))]
    body = "long enough main text <b>bold</b> <i>slanted</i>"
    p = pages(spark, f"<div class='a'>{body}</div><div class='c'>{body}</div>")
    text = A.array_pages(p, specs).select(A.format_structured().alias("content")).first()["content"]
    assert text.index("x: bold") < text.index("y: slanted") < text.index("TWO")
    assert text.rindex("y: slanted") < text.rindex("x: bold")


@pytest.mark.parametrize("body,error", [
    ('{"config":{"url":"x"}}', P.MSG_URL), ('{"url":"https://a.com"}', None), ('{"url":5}', P.MSG_BAD_URL),
    ('{"url":null}', P.MSG_BAD_URL), ("{}", P.MSG_BODY), (None, P.MSG_BODY), ('{"url":"ftp"}', P.MSG_BAD_URL),
])
def test_request_bodies(spark, body, error):
    df = spark.createDataFrame([(body,)], "body string")
    assert P.validate_requests(df).first()["error"] == error


def brute_cache(sets, gets, ttl):
    out = {}
    for g, k, t in gets:
        at = [s for kk, s in sets if kk == k and s <= t]
        last = max(at) if at else None
        out[g] = (last, last is not None and last + ttl > t)
    return out


@pytest.mark.parametrize("bucket_rows", [1, 7, 1000])
def test_hot_key_lookup_over_buckets(spark, bucket_rows):
    r = random.Random(bucket_rows)
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
    sets = [(key(), r.randint(0, 300)) for _ in range(150)]
    gets = [(i, key(), r.randint(0, 300)) for i in range(200)]
    t = lambda s: F.timestamp_seconds(F.col(s))
    s = spark.createDataFrame(sets, "key string, s long").select("key", t("s").alias("ts"))
    g = spark.createDataFrame(gets, "get_id long, key string, s long").select("get_id", "key", t("s").alias("ts"))
    got = W.cache_lookup(g, s, ttl_seconds=20, bucket_rows=bucket_rows).select("get_id", F.unix_timestamp("set_ts").alias("s"), "hit").collect()
    want = brute_cache([(k, x) for k, x in sets], gets, 20)
    assert {x["get_id"]: (x["s"], x["hit"]) for x in got} == {g: w for g, w in want.items()}


@pytest.mark.parametrize("bucket_rows", [1, 5, 1000])
def test_hot_key_verdicts_over_buckets(spark, bucket_rows):
    r = random.Random(bucket_rows)
    rows = [(i, "hot" if r.random() < 0.9 else "b", r.randint(0, 7200)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    limits = (("1 minute", 1), ("1 hour", 40))
    got = {x["event_id"]: (x["n_0"], x["n_1"], x["allowed"]) for x in W.rate_verdict(df, limits, bucket_rows=bucket_rows).collect()}
    for i, k, t in rows:
        n = [sum(1 for j, kk, tt in rows if kk == k and tt // w == t // w and (tt, j) <= (t, i)) for w in (60, 3600)]
        assert got[i] == (*n, n[0] <= 1 and n[1] <= 40)


def test_buckets_bound_the_rows_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 18_000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    per = W.range_buckets(df, ["k", "id"], bucket_rows=500).groupBy("_bkt").count().collect()
    assert max(x["count"] for x in per) <= 500 and sum(x["count"] for x in per) == 20_000


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_all_pages_are_numbered(spark, bucket_rows):
    df = spark.range(101).select(F.reverse(F.col("id").cast("string")).alias("u"), "id").repartition(7)
    got = W.paginate(df, ["u", "id"], 10, bucket_rows=bucket_rows).orderBy("u", "id").collect()
    assert [x["page_no"] for x in got] == [i // 10 + 1 for i in range(101)] and {x["pages"] for x in got} == {11}
    assert W.paginate(df, ["u", "id"], 10, page=11).count() == 1


def test_cache_delete(spark):
    cache = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, v long")
    gone = spark.createDataFrame([("b",), ("b",), ("z",)], "key string")
    assert [tuple(r) for r in W.cache_delete(cache, gone).collect()] == [("a", 1)]


def test_first_in_ttl():
    keep, last = ST.first_in_ttl(np.array([0, 5, 10, 12, 25]), -1, 10)
    assert keep.tolist() == [True, False, True, False, True] and last == 25
    keep, last = ST.first_in_ttl(np.array([30, 36]), 25, 10)
    assert keep.tolist() == [False, True] and last == 36


def plain_groups(texts, threshold):
    sets = {}
    for i, t in texts:
        w = " ".join((t or "").lower().split()).split()
        if w:
            sets[i] = {" ".join(w[j:j + 5]) for j in range(max(1, len(w) - 4))}
    rep = {i: i for i, _ in texts}

    def find(x):
        while rep[x] != x:
            x = rep[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                rep[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in texts}


def test_near_duplicates_lose_no_pair(spark, monkeypatch):
    """Templated pages whose buckets are headed by strangers, and copies with a few words changed."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    template = [r.choice(words) for _ in range(60)]
    texts = []
    for i in range(120):
        own = [r.choice(words) for _ in range(r.randint(8, 40))]
        texts.append(template + own)
    for k in range(60):
        copy = list(texts[k])
        copy[r.randrange(len(copy))] = "changed"
        texts.append(copy)
    chain = [r.choice(words) for _ in range(100)]
    for _ in range(12):                                  # a chain: only neighbours are alike
        chain = chain[4:] + [r.choice(words) for _ in range(4)]
        texts.append(list(chain))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "a b"), (903, "A  b"), (904, "")]
    monkeypatch.setattr(ND, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["rep"] for x in ND.near_duplicates(df, "doc_id", "text").collect()}
    assert got == plain_groups(rows, ND.THRESHOLD)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)]
    got = {x["node"]: x["root"] for x in ND.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_boilerplate_removal_against_plain_loop(spark):
    lines = ["Sign up for our newsletter", "Copyright by us all", "short", "Only this one says so"]
    docs = [(i, f"h{i % 2}", "\n".join([lines[i % 2], f"own line number {i} is long", "short", lines[3] if i == 4 else "x"])) for i in range(8)]
    docs += [(20, None, None), (21, None, "a line without a group")]
    got = {r["i"]: r["t"] for r in E.drop_boilerplate(spark.createDataFrame(docs, "i long, g string, t string"), "i", "t", "g", 3).collect()}
    for i, _, t in docs:
        want = None if t is None else "\n".join(x for x in t.split("\n") if not (x in lines[:2] and i < 20))
        assert got[i] == want


def test_vocabulary_within_its_error(spark):
    df = spark.createDataFrame([(f"g{i % 3}", " ".join(f"Word{(i * 37 + j) % 5000} of" for j in range(200))) for i in range(90)], "g string, t string")
    want = {r["g"]: r["n"] for r in df.select("g", F.explode(F.split(F.lower("t"), " ")).alias("w")).where("length(w) > 3")
            .groupBy("g").agg(F.countDistinct("w").alias("n")).collect()}
    got = stats.corpus_vocabulary(df, "g", "t").collect()
    for r in got:
        if r["level"] == 0:
            assert abs(r["unique_words"] - want[r["g"]]) <= 0.04 * want[r["g"]] and r["total_words"] == 30 * 400
        else:
            every = len({(i * 37 + j) % 5000 for i in range(90) for j in range(200)})
            assert abs(r["unique_words"] - every) <= 0.04 * every and r["total_words"] == 90 * 400


def test_array_modes(spark):
    html = "<title>L</title>" + "".join(f"<li class='it'>item number {i} {'abcdefgh'[i % 8] * 9} <a href='/x{i}'>go</a></li>" for i in range(70))
    p = pages(spark, html)
    spec = ArraySpec("rows", ".it", (("link", "a"),))
    full = V.run_mode(p, "array", arrays=[spec]).first()
    assert full["title"] == "L" and full["extraction_mode"] == "array_based_ordered" and full["arrays"][0]["found"] == 50
    assert len(V.run_mode(p, "array_simple", arrays=[spec]).collect()) <= 20
    row = V.run_mode(p, "array_batch", arrays=[ArraySpec("rows", ".it", (("link", "a"), ("none", "b")), 90)]).first()
    assert row["total_found"] == len(row["items"]) <= 50 and row["items"][0]["fields"] == {"link": "https://a.com/x0", "none": ""}
    with pytest.raises(ValueError):
        V.run_mode(p, "array", arrays=[spec] * 6)
    with pytest.raises(ValueError):
        V.run_mode(p, "array")
    flat = V.array_results(p, [spec], output="flat").first()
    assert flat["content"].startswith("item number 0 aaaaaaaaa go\n\n")


def test_batches_apply_the_mode_cap(spark):
    p = pages(spark, PAGE, PAGE)
    req = spark.createDataFrame([(1, ["https://a.com/1", "https://a.com/9", "https://a.com/0"]), (2, ["https://a.com/0"] * 4), (3, [])],
                                "batch_id long, urls array<string>")
    got = V.run_batch(req, p, "array_batch", arrays=[ArraySpec("h", "main", (("t", "h1"),))]).orderBy("batch_id", "batch_pos").collect()
    assert [(r["batch_id"], r["batch_pos"], r["found"]) for r in got] == [(1, 0, True), (1, 1, False), (1, 2, True), (2, -1, False), (3, -1, False)]
    assert got[0]["result"]["total_found"] == 1 and "Maximum 3" in got[3]["error"]
    crawl = V.run_batch(req, p, "content_batch").where("batch_id = 2").collect()
    assert len(crawl) == 4 and all(r["result"]["success"] for r in crawl)


def test_analysis(spark):
    got = V.run_mode(pages(spark, PAGE), "analyze").first()
    assert got["content_preview"].startswith("Head line") and [s["selector"] for s in got["suggested_selectors"]][:2] == ["main", "article"]
    assert len(got["suggested_selectors"]) == 5 and len(got["exclude_suggestions"]) == 5


@pytest.mark.parametrize("mode", ["basic", "content", "selective", "array"])
def test_metadata_of_every_mode(spark, mode):
    p = pages(spark, PAGE)
    out = {"basic": lambda: C.basic_content(p), "content": lambda: C.content_only(p), "selective": lambda: S.selective(p, SelectiveSpec(("h1",))),
           "array": lambda: V.array_results(p, [ArraySpec("h", "h1")])}[mode]()
    assert set(out.select(V.result_metadata(mode, out).alias("m")).first()["m"].asDict()) == set(V.METADATA[mode])


def test_partitions_do_not_matter(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    spec = SelectiveSpec(("article", ".ad"), (), 5000)
    for fn in (C.content_only, lambda x: S.selective(x, spec)):
        one = sorted(str(r) for r in fn(p.coalesce(1)).collect())
        assert one == sorted(str(r) for r in fn(p.repartition(7)).collect())


def test_uncut_contents(spark):
    long = "<main>" + "".join(f"<p>sentence number {i} stands here.</p>" for i in range(900)) + "</main>"
    p = pages(spark, long)
    assert C.content_only(p, 100, uncut=True).first()["content_length"] > 20_000
    assert len(S.selective(p, SelectiveSpec(max_length=100), uncut=True).first()["content"]) > 20_000


def test_auto_fields(spark):
    html = ("<div class='n'><h2>First title here</h2><p>Some content words</p><a href='/x'>more</a><img src='i.jpg'>"
            "<span class='author'>Ann</span></div><div class='n'>Only a main text in this one</div>")
    got = V.auto_fields(pages(spark, html), ".n").orderBy("index").collect()
    assert got[0]["title"] == "First title here" and got[0]["content"] == "Some content words"
    assert got[0]["image"] == "https://a.com/i.jpg" and got[0]["link"] == "https://a.com/x" and got[0]["author"] == "Ann"
    assert got[1]["content"] == "Only a main text in this one" and got[1]["title"] == "" and got[1]["date"] == ""


def test_modes_apply_their_limits(spark):
    p = pages(spark, PAGE)
    assert len(V.run_mode(p, "content_fast", 9).first()["content"]) <= 12
    with pytest.raises(ValueError):
        V.run_mode(p, "selective_get", spec=SelectiveSpec(tuple("abcdef")))


def test_envelopes(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "page_id long, payload string")
    assert V.success_envelope(df, "payload").first().asDict() == {"page_id": 1, "success": True, "message": "Success", "data": "x"}
    assert df.select(V.error_json(F.lit("e"), F.lit(None).cast("string"))).first()[0] == '{"success":false,"error":"e"}'
    with pytest.raises(ValueError):
        V.write_results(df, str(tmp_path / "r"), "xml")


def test_media_switches(spark):
    p = pages(spark, "<a href='/b'>in</a><a href='https://other.org/'>out</a><img src='/i.png' alt='pic'>")
    full = V.with_media(p, p).first()
    assert [x["href"] for x in full["internal_links"]] == ["https://a.com/b"]
    assert [x["href"] for x in full["external_links"]] == ["https://other.org/"] and full["images"][0]["alt"] == "pic"
    none = V.with_media(p, p, skip_images=True, skip_links=True).first()
    assert none["images"] == [] and none["internal_links"] == [] and none["external_links"] == []


def test_stored_tables_are_released(spark, tmp_path):
    import os

    from pageloom.session import stored, temporary_tables
    with temporary_tables(spark):
        t = stored(spark.range(5), "released")
        path = t.inputFiles()[0].replace("file://", "")
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_links_of_pages_and_listings_are_split(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.com/x/", '<a href="/one">One</a><a href="two">Two</a>')], "page_id long, url string, html string") \
        .write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, "Brand#11", f"part {k}", 9.5, "steel", 3) for k in (1, 2)],
                          "p_partkey long, p_brand string, p_name string, p_retailprice double, p_type string, p_size int") \
        .write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["page_id"], r["pos"]): (r["href"], r["internal"]) for r in QUERIES["l2_split_internal_external"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("https://a.com/one", True), (1, 1): ("https://www.far.example.org/x/two", False),
                   (1_000_000_011, 0): ("https://shop.example.com/p/1", True), (1_000_000_011, 1): ("https://www.far.example.org/p/2", False)}


def test_few_blocks_as_by_index():
    draw = random.Random(3)
    words = ["alpha beta", "gamma delta", "epsilon zeta eta", "theta iota"]
    for _ in range(200):
        few, many = E.FewBlocks(), E.KeptBlocks()
        for i in range(draw.randrange(1, 30)):
            t = " ".join(draw.choice(words) for _ in range(draw.randrange(2, 7)))
            assert few.offer(t, f"{i}") == many.offer(t, f"{i}")
        assert few.raw == many.raw and list(few.raw) == list(many.raw)


def test_similarity_bounds_decide_as_the_ratio():
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcde ") for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    texts += [t[:-2] + "xy" for t in texts]
    assert all(E._above(a, b, 0.75) == (E.difflib.SequenceMatcher(None, a, b).ratio() > 0.75) for a in texts for b in texts)


def test_few_rows_are_objects_at_a_time(spark):
    """A batch of 10,000 pages was turned into Python objects at once."""
    import pyarrow as pa
    from pyspark.sql import types as T
    seen = []
    udf = E._by_slices(lambda a: seen.append(a) or a, T.StringType(), pa.string())
    values = pa.array([["a"], None, []] * 100, pa.list_(pa.string()))
    assert udf.func(values).to_pylist() == values.to_pylist() and len(seen) == 300
    df = spark.createDataFrame([(["some words that are long enough", "some words that are long enough", "short"],)], "a array<string>")
    assert df.select(E.kept_items("a")).first()[0] == [0]


def test_item_rows_build_the_items_once(spark):
    """A filter inferred from the explode built all items three times more."""
    spec = [ArraySpec("items", "p", (("link", "a"),), None)]
    rows = A.item_rows(A.absolutize_pages(A.array_pages(pages(spark, PAGE), spec, dedup_items=False), spec))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1
    assert [r["main_content"] for r in rows.collect()] == ["Some words are here."]
