"""Segment-tree encoding against the public library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as public
    import tiktoken

    from tidelog.llm.segment_bpe import RankBpe

    own = RankBpe(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return own, library


def encoded(own, texts):
    parts = [b""] * len(texts)
    for row, part in own.encoder()(texts):
        parts[row] += part
    return [np.frombuffer(p, "<u4").tolist() for p in parts]


def same(bpe, texts):
    own, library = bpe
    for text, ids in zip(texts, encoded(own, texts), strict=True):
        assert ids == library.encode_ordinary(text)
        assert own.decode(np.array(ids)) == text.encode()


def test_every_code_point(bpe):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(bpe, ["".join(chars[i : i + 5000]) for i in range(0, len(chars), 5000)])
    same(bpe, [f"a{c}b {c} {c}1{c}{c}" for c in chars[:0x3100]])


def test_long_matches(bpe):
    letters = random.Random(5)
    texts = ["", " ", "a", "x" * 100_000, " " * 5000 + "a", "ab" * 3000, "<|endoftext|>", "".join(letters.choices("etaoin", k=40_000)),
             *("".join(letters.choices("abcé日", k=k)) for k in range(1, 140))]
    same(bpe, texts)


def test_one_tree_and_forest_agree(bpe):
    own, _ = bpe
    letters = random.Random(6)
    words = [bytes(letters.choices(b"aehilnorst'", k=k)) for k in range(2, 65) for _ in range(20)]
    for leaf in (2, 4, 8, 16, 32, 64):
        some = [w for w in words if leaf // 2 < len(w) <= leaf and w not in own.ranks]
        got = [np.frombuffer(p, "<u4").tolist() for p in own.encode_forest(some, leaf)]
        assert got == [own.encode_match(w) for w in some]


def test_a_text_in_parts_and_a_full_memory(bpe, monkeypatch):
    from tidelog.llm import segment_bpe

    monkeypatch.setattr(segment_bpe, "STEP", 7)
    monkeypatch.setattr(segment_bpe, "REMEMBERED", 5)
    same(bpe, ["one two  three\n four five six seven eight nine ten", "", "one two", "it's   we'll " * 9])


def test_queries(spark):
    import public_tokenizers as public
    import tiktoken

    from tidelog.llm.queries import op13_segment_bpe
    from tidelog.llm.segment_bpe import load, segment_decode, segment_digests, segment_encode

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = load(path, public.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digests(rows):
        out = Counter()
        for i, text in rows:
            ids = np.array(library.encode_ordinary(text or ""), "<u4")
            out[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
        return out

    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, op13_segment_bpe(spark, SF).collect())) == digests(small)
    rows = [(1, None), (2, ""), (3, "tie tie"), (3, "tie tie"), (None, "no id"), (4, "x" * 50_000), (5, "ça 日本語 😀")]
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, ids string, n_tokens int, _text string")
    assert Counter(map(tuple, segment_digests(docs, path, public.PATTERN).collect())) == digests(rows)
    back = segment_decode(segment_encode(docs, path, public.PATTERN), path, public.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back) == Counter((i, t or "") for i, t in rows)
    assert segment_digests(docs.limit(0), path, public.PATTERN).count() == 0
