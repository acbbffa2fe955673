import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlane.llm import bpe, packing, queries, token_counts
from emberlane.llm.tokens import ByteBpe
from tests.llm.tables import TEXTS, no_documents, odd_documents

BYTES, WORDS = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("word_bpe_49k.json")
PARTS = list("aaeéÀ 's 't  \n\t 12٣²½ΣİßÉ日本.,!?-_́​\x1c\x85\xa0") + ["<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "ing", "tion", "'re"]


@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def test_encoders_equal_the_library(library):
    mine, words, draw = ByteBpe(BYTES), bpe.WordBpe(WORDS), random.Random(2)
    texts = [t or "" for _, t in TEXTS] + ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(3000)]
    texts += ["x" + chr(c) + "y " for c in (*range(0x500), 0x1F600, 0x10400)]
    for text in texts:
        assert mine.encode(text) == ids_of(library, BYTES, text)
        wanted = ids_of(library, WORDS, text)
        ids, spelled, n = words.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == wanted and n == len(wanted)
        assert spelled.decode() == words.decode(wanted) == library[WORDS].decode(wanted, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merging_leaves_alone(library):
    words, draw = bpe.WordBpe(WORDS), random.Random(4)
    inner = [t for t in (t for t in library[WORDS].get_vocab()) if t.isascii() and t.isalpha() and len(t) > 1]
    vocabulary = library[WORDS].get_vocab()
    for _ in range(2000):
        a, b = draw.choice(inner), draw.choice(inner) + "</w>"
        if b in vocabulary:
            pair = [vocabulary[a], vocabulary[b]]
            assert words.compatible(*pair) == (ids_of(library, WORDS, a + b[:-4]) == pair)


def test_counts_and_what_the_cache_keeps(spark, library, tmp_path):
    cache = str(tmp_path / "cache")
    docs = odd_documents(spark)
    for _ in range(2):  # the second run finds everything stored
        got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BYTES, cache, limit=10).collect()]
        wanted = [(i, len((t or "").encode()), n := len(ids_of(library, BYTES, t)), n > 10) for i, t in TEXTS]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in TEXTS})
    more = spark.createDataFrame([(1, "a new text"), (2, "a")], "doc_id bigint, text string")
    assert token_counts.token_counts(more, BYTES, cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in TEXTS}) + 1
    assert token_counts.token_counts(no_documents(spark), BYTES, str(tmp_path / "other")).count() == 0


def test_word_ids_and_decoding(spark, library):
    for r in bpe.encode_digests(odd_documents(spark), WORDS).collect():
        text = next(t for i, t in TEXTS if i == r.doc_id)
        ids = ids_of(library, WORDS, text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[WORDS].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(odd_documents(spark), WORDS)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, WORDS).collect()}
    assert all(back[r.doc_id] == r.decoded.decode() for r in encoded.collect())
    assert bpe.encode_digests(no_documents(spark), WORDS).count() == 0


def check_packing(pieces, texts, library, capacity):
    by_row, sequences = {}, {}
    for r in pieces:
        by_row.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for text_id, text in texts:
        ids = [*ids_of(library, BYTES, text), 0]
        own = sorted((r for r in by_row[text_id]), key=lambda r: r.piece)
        own = own[:: max(1, sum(i == text_id for i, _ in texts))]
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // capacity) and all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, library):
    assert packing.pack(no_documents(spark), BYTES).count() == 0
    pieces = packing.pack(odd_documents(spark), BYTES, capacity=64).collect()
    check_packing(pieces, TEXTS, library, 64)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_a_plan_places_every_piece_once_and_wastes_little(counts):
    capacity = 40
    placed, fill, last = {}, {}, {}
    for length, first, n, each, sequence, offset in packing.plan_sequences(counts, capacity):
        assert first == placed.get(length, 0) and n % each == 0
        placed[length] = first + n
        for rank in range(n):
            fill.setdefault(sequence + rank // each, []).append((offset + rank % each * length, length))
    assert placed == counts
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # First-fit decreasing on its own, as a yardstick.
    bins = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = next((k for k, room in enumerate(bins) if room >= length), None)
        if fit is None:
            bins.append(capacity - length)
        else:
            bins[fit] -= length
    assert len(fill) <= len(bins) + max(1, len(bins) // 20)
