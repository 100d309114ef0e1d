"""Token alignment against a plain alignment with the libraries, and the perfect hash."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import align
from pageloom.llm.bytebpe import byte_alphabet
from pageloom.llm.perfecthash import PerfectHash

from .conftest import DOCS, odd_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Expected rows, in the order of ``texts``."""
    a_tok, letters, sp = Tokenizer.from_file(A), byte_alphabet(), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    cut, counts = [], Counter()
    for t in texts:
        a = a_tok.encode(f" {t}", add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or {b"".join(a_bytes), b"".join(b_bytes)} != {f" {t}".encode()}:
            cut.append(([], [], [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        both, groups, links, i, j = sorted(set(a_end) & set(b_end)), [], [], 0, 0
        for stop in both:
            k, m = a_end.index(stop, i) + 1, b_end.index(stop, j) + 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        counts.update(links)
        cut.append((a, b, links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(a), len(b), len(ln), len(ln), sum(counts[x] == best[x[1]] for x in ln), sum(counts[x] for x in ln), g)
            for a, b, ln, g in cut]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(documents, table, monkeypatch, small):
    if small:                                          # many shards and a deep tree
        for name, value in (("SHARD_KEYS", 64), ("LEAF_ROWS", 250), ("FAN", 2), ("MOST_SHARDS", 3)):
            monkeypatch.setattr(align, name, value)
    odd = odd_documents() + [(70 + i, t, "", "", 0) for i, t in enumerate(
        ["a▁b", "▁", " lead", "<s> <|endoftext|> <0x41>", "\x00 nul", "ﬁ ½ é", "tab\tnew\r\nline  ", "日本語 text"])]
    docs = table(odd, DOCS).withColumn("n_a", F.lit(1)) if not small else documents.limit(60)
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), *x) for r, x in zip(rows, plain([r["text"] for r in rows]), strict=True))
    got = align.alignments(docs, A, B).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == want
    assert any(w[1] for w in want) and (small or any(not w[1] for w in want))


def test_empty(spark):
    assert align.alignments(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-2**62, 2**62, 50_000))
    fn, own = PerfectHash.unpacked(PerfectHash.build(keys).packed(keys))
    assert np.array_equal(np.sort(fn.numbers(keys)), np.arange(keys.size))         # minimal and perfect
    assert np.array_equal(own[fn.numbers(keys)], keys)
    other = keys + 1
    number = fn.numbers(other)
    assert not (own[number][number >= 0] == other[number >= 0])[~np.isin(other, keys)[number >= 0]].any()
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([5, 5]))
    assert PerfectHash.build(np.zeros(0, dtype=np.int64)).numbers(keys[:3]).tolist() == [-1, -1, -1]


def test_unknown_pair_is_an_error(spark, documents):
    pair = align.load_pair(A, B)
    known = align.count_pairs(documents.limit(5), pair)
    with pytest.raises(RuntimeError, match="missing"):
        known.counts(np.array([2**40]))
