"""The pipeline against its own stages run one by one, and against plain Python."""

import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm.store import keep

from .conftest import DOCS, LOWER


def test_stages_and_run(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, d), "stage")
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        ids = left
    assert docs.where("text rlike '[a-z0-9]+@mail[0-9]'").count() == 0
    packed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    fill = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 1024 for r in fill)
    assert len(corpus_pipeline.STAGES) == 5


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0D]+", t.translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_run_against_brute_force(spark, tmp_path):
    """Every stage replaced by plain Python on a small table with odd rows; no labels, so no document is toxic."""
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("no", "sa", "vi", "pe", "du", "x")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(25, 90))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(10)] + [(120, rows[3][1]), (121, rows[3][1])]      # copies, ties
    rows += [(200 + i, text(r.randint(0, 19))) for i in range(8)] + [(210, None), (211, ""), (212, "word " * 60), (213, text(3000))]
    rows += [(300 + i, f"{text(30)} write to jo{i}@example.com or 10.0.0.{i} now {text(5)}") for i in range(5)]
    docs = [(i, t, "en", f"h{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def passes(t):
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        seen = collections.defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i:i + 8])].append(i)
        covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    left = {i: t for i, t in rows if passes(t)}
    sets, rep = {i: shingle_set(t) for i, t in left.items()}, {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((rep[a], rep[b]))
                rep = {i: low if x == high else x for i, x in rep.items()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in left:
        if rep[i] == i:
            t = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", left[i])
            t = re.sub(r"\b10\.0\.0\.\d\b", "[IP]", t)
            ids = tok.encode(t, add_special_tokens=False).ids + [2]
            head = (len(ids) - 1) % 1024 + 1
            for k, (s, n) in enumerate([(0, head)] + [(s, 1024) for s in range(head, len(ids), 1024)]):
                want.append((i, k, s, n, zlib.crc32(np.array(ids[s:s + n], dtype="<u4").tobytes())))
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    by = collections.defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for seq in by.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at <= 1024


def test_run_on_empty_tables_and_odd_columns(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for c in ("_row", "_base", "n_lines", "kept", "node", "label"):
        docs = docs.withColumn(c, F.lit(3))
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "odd"))
        assert out.columns == docs.columns, name
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} == {
        r["doc_id"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
