import base64

import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import packing, tokens
from quarry.llm.bpe import LONGEST_KEPT_WORD, TrieEncoder

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

import numpy as np  # noqa: E402

OURS = TrieEncoder(tokens.vocabulary_path())
SMALL_CACHE = TrieEncoder(tokens.vocabulary_path(), most_cached=3)


@pytest.fixture(scope="module")
def by_ranks():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text, own=OURS):
    return np.frombuffer(own.encode_batch([text])[0], "<i4").tolist()


RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = "abcdestrinxyzé ßжбاあ漢🎉 '`.,;:(){}[]=-_+*/\\\"<>0123456789\n\t\r \x1c\x85​　"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=80))
def test_same_ids_as_another_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert ids(text, SMALL_CACHE) == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=50), max_size=5), st.integers(1, 20))
def test_parts_change_nothing(texts, most):
    got = OURS.encode_batch([None, *texts, ""], most_characters=most)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [[], *[REFERENCE.encode_ordinary(t) for t in texts], []]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    text = text.encode("utf-8", "ignore").decode()
    raw = b"".join(OURS.bytes_of[i] for i in ids(text))
    assert raw.decode() == text and ids(text) == REFERENCE.encode_ordinary(text)


def test_long_and_repeated(by_ranks):
    for text in ("a" * 5000, "aaab" * 900, "-" * 300 + " " * 500 + "x", "<|endoftext|>", "QmFz" * 2000, " " * 100, "x" * LONGEST_KEPT_WORD, "x" * (LONGEST_KEPT_WORD + 1)):
        assert ids(text) == by_ranks.encode_ordinary(text)
    other = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert ids("plain text, 12 words") == other.encode("plain text, 12 words", add_special_tokens=False).ids


DOCS = "doc_id long, text string, ids string"


def test_tables(spark):
    rows = [(1, "hello world", "clash"), (2, "", None), (3, None, None), (1, "hello world", "clash"), (None, "x", None), (4, "word " * 30_000, None)]
    frame = spark.createDataFrame(rows, DOCS)
    out = tokens.encode_texts(frame).collect()
    assert len(out) == 6 and {r["doc_id"]: r["ids"] for r in out}[1] == REFERENCE.encode_ordinary("hello world")
    assert all(r["ids"] == [] for r in out if r["doc_id"] in (2, 3))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame).collect()}[4] == len(REFERENCE.encode_ordinary("word " * 30_000))
    assert tokens.encode_texts(frame.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200))
def test_packing(sizes):
    of, count = packing.pack_block(sizes, 64)
    filled = [0] * count
    for size, container in zip(sizes, of):
        filled[container] += size
    assert len(of) == len(sizes) and all(f <= 64 for f in filled)
    assert sum(f <= 32 for f in filled) <= max(1, count // 2)


def by_scan(sizes, capacity):
    """The same rule by looking at all containers for each item."""
    room, spent, out = [capacity] * -(-sum(sizes) // capacity), [0.0] * -(-sum(sizes) // capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda x: -sizes[x]):
        fits = [c for c in range(len(room)) if room[c] >= sizes[i]]
        if not fits:
            room.append(capacity), spent.append(0.0)
            fits = [len(room) - 1]
        c = min(fits, key=lambda x: (spent[x], x))
        room[c] -= sizes[i]
        spent[c] += packing.cost(sizes[i])
        out[i] = c
    return out, len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_packing_takes_the_cheapest_that_has_room(sizes):
    assert packing.pack_block(sizes, 100) == by_scan(sizes, 100)


def test_fill(spark):
    import random

    rng = random.Random(4)
    sizes = [min(2048, int(rng.lognormvariate(5, 1.2))) for _ in range(5000)]
    of, count = packing.pack_block(sizes)
    assert sum(sizes) / (count * 2048) > 0.98
    rows = [(1, "word " * 5000, None), (2, "", None), (3, None, None), (4, "short", None), (5, " word" * 2048, None), (6, " word" * 2049, None), (4, "short", None)]
    packed = packing.pack_documents(spark.createDataFrame(rows, DOCS), block=3).collect()
    assert {r["doc_id"] for r in packing.split_documents(packing.pack_documents(spark.createDataFrame(rows, DOCS))).collect()} == {1, 6}
    room = {}
    for r in packed:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
    assert max(room.values()) <= 2048 and sum(r["doc_id"] == 4 for r in packed) == 2
    whole = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in packed if r["doc_id"] == 1)
    assert [w[0] for w in whole] == list(range(len(whole))) and all(a[1] + a[2] == b[1] for a, b in zip(whole, whole[1:]))
    assert packing.pack_documents(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0
    assert packing.container_fill(packing.pack_documents(spark.createDataFrame(rows, DOCS))).first()["fill"] <= 1


def test_long_words_share_prefixes():
    coder = TrieEncoder(tokens.vocabulary_path())
    stem = "abcdefghij" * 30
    words = [stem, stem + "x", stem + "xyz", stem[:200] + "ü" * 40, "q" * 500, stem + "x" * 300]
    steps, real = [], coder._last_token
    coder._last_token = lambda word, end, last: steps.append(end) or real(word, end, last)
    together = coder.encode_batch(words)
    # Each distinct prefix is worked out once.
    distinct = {w.encode()[:i] for w in words for i in range(1, len(w.encode()) + 1)}
    assert len(steps) == len(distinct)
    coder._last_token = real
    assert together == [TrieEncoder(tokens.vocabulary_path()).encode_batch([w])[0] for w in words]
