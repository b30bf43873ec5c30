import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesselann.llm import packing as P


def exact():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["", " ", "Hello  world\n\n\n x", "naïve 漢字 ⅷ ½ I'll we've", "a" * 5000, "x <|endoftext|> y", "​﻿\x00\x1f", "1234567 don't\t\t  end  "])
def test_ids(text):
    assert P.encoder()(text) == exact().encode(text, add_special_tokens=False).ids


def test_ids_of_documents(sample):
    texts = [r.text for r in sample.collect()]
    assert [P.encoder()(t) for t in texts] == [e.ids for e in exact().encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill(counts, room):
    own = P.fill(counts, room)
    assert all(n <= counts[k] for k, n in own.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in own.items()) == max(s for s in sums if s <= room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 50), max_size=10))
def test_plan(counts):
    fills = P.plan(counts, 16)
    used = {}
    for own, times in fills:
        assert sum(k * n for k, n in own.items()) <= 16
        for k, n in own.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts and len(fills) <= 5 * len(counts)


def check(rows, ids_of, window=P.WINDOW):
    by, docs = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    for doc, want in ids_of.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            part = np.array(want[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32, len(part)) == (at, len(want), zlib.crc32(part.tobytes()), r.length)
            at += r.length
        assert at == len(want)
    return len(by)


def test_pack(sample):
    rows = P.pack(sample).collect()
    ids = {r.doc_id: [*P.encoder()(r.text), 1] for r in sample.collect()}
    n, total = check(rows, ids), sum(map(len, ids.values()))
    assert n == -(-total // P.WINDOW) or n * P.WINDOW - total < 0.01 * total + P.WINDOW


def test_odd(clashing, docs_of):
    rows = P.pack(clashing.drop("curve")).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 1 for r in rows) == 2
    check([r for r in rows], {2: [1], 3: [1], 7: [*P.encoder()("é ü 漢字 ß"), 1]})
    assert P.pack(docs_of([])).count() == 0
    check(P.pack(docs_of(["abcdefg", "ab", "c"]), 4, lambda t: [ord(c) for c in t]).collect(), {0: [*map(ord, "abcdefg"), 1], 1: [97, 98, 1], 2: [99, 1]}, 4)


@pytest.mark.parametrize("text", [" " * (P.RUN + 5) + "a", "a" + "\n \t" * P.RUN + "b", " " * 1_100_000 + "x"])
def test_long_white_space(text):
    assert P.encoder()(text) == exact().encode(text, add_special_tokens=False).ids
