"""Alignment of two tokenizers against plain loops over tokens."""

import base64
import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm.alignment import Alignment, ByteLevel, Pieces, align, planes, unplanes
from textmill.llm.queries import QUERIES, TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no tokenizer files")
ODD = ["", "a", "plain words, and more.", "two\nlines\r\n\ttabs  and   blanks ", "naïve café ñandú 中文字 🙂🙂", "▁ is written as it is",
       "<0x41> <|endoftext|> </s> <unk>", "\x00 nul", "x" * 3000, " " * 500, "é Å", "ﷺ ｆｕｌｌ"]


@pytest.fixture(scope="module")
def tokenizers():
    return ByteLevel(A), Pieces(B)


def plain(texts, tokenizers):
    """text to its measures, by loops over tokens and over pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    of_char = {c: bytes([b]) for c, b in __import__("textmill.llm.alignment", fromlist=["x"]).byte_of_char().items()}

    def cut(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    parts = {}
    for text in set(texts) - {None, ""}:
        a = slow.encode(" " + text, add_special_tokens=False)
        b = pieces.encode(text)
        ta = [b"".join(of_char[c] for c in slow.id_to_token(i)) for i in a.ids]
        tb = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
              for i in b]
        if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            continue
        ca, cb = cut(ta), cut(tb)
        links = [(i, j) for i, (s, e) in zip(a.ids, ca) for j, (x, y) in zip(b, cb) if s < y and x < e]
        ends = sorted({e for _, e in ca} & {e for _, e in cb})
        groups, low = [], 0
        for high in ends:
            groups.append(",".join(str(i) for i, (s, e) in zip(a.ids, ca) if low <= s and e <= high) + "|"
                          + ",".join(str(i) for i, (s, e) in zip(b, cb) if low <= s and e <= high))
            low = high
        parts[text] = len(ca), len(cb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
    counts = Counter(p for t in texts if t in parts for p in set(parts[t][3]))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    return {t: (p[0], p[1], p[2], len(p[3]), sum(counts[x] == top[x[0]] for x in p[3]), sum(counts[x] for x in p[3]), p[4])
            for t, p in parts.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(rows, texts, tokenizers):
    want = plain(list(texts.values()), tokenizers)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want.get(texts[r["doc_id"]], (0, 0, 0, 0, 0, 0, "")), texts[r["doc_id"]]


def test_fast_and_slow_encoders_agree(tokenizers):
    one, _ = tokenizers
    assert one._fast is not None
    for t in [*ODD, "<|endoftext|>", "  leading", "1234567890" * 50]:
        assert one.encode(" " + t).tolist() == one._slow.encode(" " + t, add_special_tokens=False).ids


def test_very_long_runs(tokenizers):
    one, _ = tokenizers
    assert one.vocabulary.spelled(one.encode(" " * 400_000)).tobytes() == b" " * 400_000


def test_merges_rank_the_vocabulary(tokenizers):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    assert tokenizers[0]._fast._mergeable_ranks == ranks


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 2**32 - 1], np.uint32)
    assert unplanes(planes(x)).tolist() == x.tolist()


def test_misspelt_tokens_align_nothing(tokenizers):
    one, two = tokenizers
    ids = [one.encode(" good"), one.encode(" bad")[:0]]
    al = align(["good", "bad"], ids, two.encode(["good", "bad"]), one.vocabulary, two.vocabulary)
    assert al.place.tolist() == [0]


def test_rows_of_all_kinds(spark, tokenizers):
    texts = dict(enumerate([*ODD, None, *ODD[2:6], ODD[2], "long " * 30_000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("digest", "weight", "a", "b", "n", "best", "pairs", "n_a")])
    short = {k: v for k, v in texts.items() if v is None or len(v) < 9000}
    got = Alignment.build(clash, A, B).of_rows(clash).collect()
    assert len(got) == len(texts)
    long = [r for r in got if r["doc_id"] not in short]
    assert long[0]["n_a"] > 0 and long[0]["n_links"] >= long[0]["n_groups"]
    # The long text's words change the counts of others, so these are compared without it.
    few = docs.filter(F.length("text").isNull() | (F.length("text") < 9000))
    check(Alignment.build(few, A, B).of_rows(few).collect(), short, tokenizers)


def test_repeated_rows_and_rows_without_id(spark, tokenizers):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, "one three")], "doc_id long, text string")
    got = Alignment.build(docs, A, B).of_rows(docs)
    want = plain([r["text"] for r in docs.collect()], tokenizers)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted([*[want["one two"]] * 3, want["one three"]])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Alignment.build(docs, A, B).of_rows(docs).count() == 0


def test_query_against_loops(spark, tables, tokenizers):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    small = {k: v for k, v in texts.items() if len(v) < 2500}
    got = QUERIES["op12_tokenizer_alignment"](spark, tables).collect()
    assert len(got) == len(texts)
    docs = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    check(Alignment.build(docs, A, B).of_rows(docs).collect(), small, tokenizers)
