"""Quality rules and token counts against plain Python."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import quality, tokens

from .conftest import DOCS, odd_documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


def expected(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts(documents, table):
    for docs in (documents, table(odd_documents(), DOCS)):
        got = sorted(quality.quality_rules(docs).select("text", *quality.COUNTS, "base_failed").collect(), key=str)
        assert len(got) == docs.count()
        for r in got:
            assert tuple(r)[1:] == expected(r["text"]), r["text"]


def test_quality_host_verdict(table):
    clean = " ".join(f"word{i}" for i in range(40))
    loud = " ".join(f"#{i}&&&" for i in range(40))
    rows = [(i, clean, "good.example") for i in range(40)] + [(100, loud, "good.example")]
    rows += [(200 + i, loud, "bad.example") for i in range(30)] + [(300, clean, "bad.example"), (301, clean, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(table(rows, "doc_id long, text string, source string")).collect()}
    assert got[100] and got[300] and got[301]                     # a lone failure and a clean text of a bad host stay
    assert not any(got[200 + i] for i in range(30))


def test_quality_prior_shrinks_small_hosts(table):
    clean, loud = " ".join(f"w{i}" for i in range(30)), " ".join(f"#{i}&&&" for i in range(30))
    rows = [(i, clean, f"h{i % 50}") for i in range(500)] + [(900, loud, "tiny")]
    ruled = quality.with_rules(quality.document_counts(table(rows, "doc_id long, text string, source string")))
    tiny = quality.host_verdicts(ruled).where("_host = 'tiny'").first()
    assert tiny["rate_symbols"] < 1.0                              # one failing document is not a rate of 1


@pytest.mark.parametrize("size", [10, 300])
def test_quality_dominant_host_among_many_small_ones(table, size):
    """One-document hosts that fail now and then do not acquit a host that always fails, at any size."""
    clean, loud = " ".join(f"w{i}" for i in range(30)), " ".join(f"#{i}&&&" for i in range(30))
    rows = [(i, loud if i % 50 == 0 else clean, f"h{i}") for i in range(600)] + [(10_000 + i, loud, "big") for i in range(size)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(table(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[10_000 + i] for i in range(size))
    assert all(got[i] for i in range(600))                        # a lone failure does not speak for its host


def test_quality_rule_failed_by_half_the_corpus(table):
    clean, loud = " ".join(f"w{i}" for i in range(30)), " ".join(f"#{i}&&&" for i in range(30))
    rows = [(i, loud if i % 2 else clean, "bad" if i % 2 else f"h{i % 7}") for i in range(400)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(table(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(1, 400, 2)) and all(got[i] for i in range(0, 400, 2))


def test_quality_columns_of_any_name(documents):
    names = ("base_failed", "fail_symbols", "bad_symbols", "_words", "_h", "_host", "n_lines", "row", "host", "kept", "n")
    docs = documents
    for n in names:
        docs = docs.withColumn(n, F.lit(7))
    got = quality.keep_documents(docs)
    assert got.columns == docs.columns and got.select(*names).distinct().collect() == [tuple([7] * len(names))]
    ids = [r["doc_id"] for r in quality.quality_rules(documents).where("kept").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(ids)
    assert quality.quality_rules(docs).select("n_lines").distinct().first()[0] == 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.quality_rules(none).count() == 0
    assert tokens.token_counts(none, BPE).count() == 0


@pytest.mark.parametrize("limit", [3, 512])
def test_token_counts(documents, table, limit):
    tok = Tokenizer.from_file(BPE)
    extra = [(50 + i, t, "", "", 0) for i, t in enumerate(
        ["<|endoftext|>", "a <|endoftext|> b<|endof", "it's we're I'LL 'sab  '' \n's", "a" * 3000, "   x\r\n "])]
    docs = table(odd_documents() + extra, DOCS).withColumn("n_tokens", F.lit(1))
    rows = docs.collect() + documents.collect()
    got = tokens.token_counts(docs, BPE, limit).collect() + tokens.token_counts(documents, BPE, limit).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len((r["text"] or "").encode()),
                   len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > limit) for r in got)
