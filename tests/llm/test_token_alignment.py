"""Cross-tokenizer alignment against laying every token over the bytes of its text."""

import base64
import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lintel.llm import token_alignment
from lintel.llm.token_alignment import align, byte_and_piece, byte_tokens

LOAD = byte_and_piece(P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """From texts to the rows that align() is to give, by its definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_bytes = byte_tokens(P.path("byte_bpe_50k.json"))

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    def rows(texts):
        linked, found = collections.Counter(), []
        for text in texts:
            a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
            b = b_model.encode(text) if text else []
            whole = (" " + text).encode() if text else b""
            if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes(i) for i in b) != whole:
                a, b = [], []
            spans = []
            for ids, of in ((a, a_bytes.__getitem__), (b, b_bytes)):
                ends = np.cumsum([0, *[len(of(i)) for i in ids]]).tolist()
                spans.append(list(zip(ids, ends[:-1], ends[1:], strict=True)))
            shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            groups = [([i for i, s, e in side if lo <= s and e <= hi]) for lo, hi in zip([0, *shared], shared, strict=False) for side in spans]
            named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(groups[::2], groups[1::2], strict=True))
            links = [(i, k) for i, s, e in spans[0] for k, t, f in spans[1] if max(s, t) < min(e, f)]
            linked.update(links)
            found.append((len(a), len(b), len(shared), links, hashlib.sha256(named.encode()).hexdigest() if named else ""))
        most = collections.Counter()
        for (_, k), n in linked.items():
            most[k] = max(most[k], n)
        return [(n_a, n_b, n, len(links), sum(linked[x] == most[x[1]] for x in links), sum(linked[x] for x in links), digest) for n_a, n_b, n, links, digest in found]

    return rows


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def wanted(rows, plain):
    return sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]), strict=True))


ODD = ["", None, " ", "a", "it's I'LL don't", "<|endoftext|> </s><s>", "a▁b", "x\x00y", "naïve Straße 日本語 𝒜𝒷 1234567 ½", "ab" * 300, "a" * 500, "  two  blanks\n\n\n\tmix ", "<0x41>", "é" * 200, "!!!??--==", "﻿z"]


def test_align_by_definition(spark, plain, sf):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, ODD[8]), (None, ODD[8]), (3, "a")]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 600).select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("code", "chunk", "part", "n", "best", "same"):
        docs = docs.withColumn(name, F.lit(1))
    want = wanted(rows, plain)
    assert got(align(docs, LOAD)) == want
    assert got(align(docs, LOAD, chunk_bytes=400)) == want  # many chunks
    assert sum(x[4] for x in want) < sum(x[5] for x in want)  # some groups are irregular
    for few in (docs.limit(0), docs.where("text is null"), docs.where("text = ''")):
        assert got(align(few, LOAD)) == wanted([tuple(r) for r in few.select("doc_id", "text").collect()], plain)


def test_vocabularies():
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = byte_tokens(P.path("byte_bpe_50k.json"))
    assert len(own) == 50257 and own[50256] == b"<|endoftext|>" and all(own[i] == x for x, i in ranks.items())


def test_summed():
    random = np.random.default_rng(2)
    codes, counts = random.integers(0, 50, 400), random.integers(1, 9, 400)
    found, sums = token_alignment._summed(codes, counts)
    assert found.tolist() == sorted(set(codes.tolist())) and sums.tolist() == [int(counts[codes == c].sum()) for c in found]
    assert [len(x) for x in token_alignment._summed(codes[:0], counts[:0])] == [0, 0]
