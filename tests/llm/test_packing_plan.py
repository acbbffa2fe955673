import itertools
import random
from collections import Counter

import pytest

from emberlane.llm import packing, queries
from emberlane.session import materialise


def ways(counts, gap):
    """All ways to make ``gap`` of one, two or three of the available lengths."""
    found = set()
    for k in (1, 2, 3):
        for parts in itertools.combinations_with_replacement(sorted(counts), k):
            if sum(parts) == gap and all(counts[p] >= n for p, n in Counter(parts).items()):
                found.add(parts)
    return found


def test_sums_and_complements_equal_brute_force():
    draw = random.Random(9)
    for _ in range(30):
        capacity = draw.choice((40, 64))
        counts = {draw.randrange(1, capacity + 1): draw.randrange(1, 4) for _ in range(12)}
        index = packing.SumIndex(counts, capacity)
        while index.have.any():
            have = [x for x, n in index.counts.items() if n]
            for k, table in ((1, index.have), (2, index.pairs), (3, index.triples)):
                sums = Counter(sum(parts) for parts in itertools.product(have, repeat=k))
                assert table.tolist() == [sums.get(s, 0) for s in range(capacity + 1)]
            length = draw.choice(have)
            gap = capacity - length
            left = {x: n - (x == length) for x, n in index.counts.items() if n - (x == length)}
            found = index.complement(length, gap)
            if not gap:
                assert found == (length,)
            elif found:
                assert found[0] == length and tuple(sorted(found[1:])) in ways(left, gap)
            else:
                assert not ways(left, gap)
            index.use(found or (length,), 1)


def placed(counts, capacity):
    """Every sequence's pieces, from the plan's rows; each piece is placed once and none over another."""
    sequences = {}
    seen = Counter()
    for length, first, n, each, sequence, offset in packing.plan_sequences(counts, capacity):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            sequences.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_plans_are_whole_and_mostly_exact():
    draw = random.Random(10)
    for capacity in (16, 64, 2048):
        for size in (0, 1, 5, 400):
            counts = Counter(draw.randrange(1, capacity + 1) for _ in range(size))
            sequences = placed(counts, capacity)
            assert len(sequences) >= -(-sum(k * v for k, v in counts.items()) // capacity)
    # What one, two or three lengths can close is closed: nothing is left over here.
    assert len(placed({60: 5, 4: 5, 30: 4, 20: 2, 14: 3, 33: 1, 31: 1}, 64)) == -(-(60 * 5 + 20 + 120 + 40 + 42 + 64) // 64)


@pytest.mark.parametrize("size, least", [("sf0.001", 96), ("sf0.01", 481)])
def test_exact_fillings_reach_the_least_number_of_sequences(spark, size, least):
    pieces = queries.QUERIES["op8_best_fit_packing"](spark, f"/root/testdata/{size}").collect()
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert len(filled) == least == -(-sum(p.length for p in pieces) // 2048)
    assert sum(n == 2048 for n in filled.values()) >= 0.6 * least


def test_only_the_pieces_are_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(packing, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    docs = spark.createDataFrame([(i, f"document {i % 3} " * (i % 7)) for i in range(60)], "doc_id long, text string")
    rows = packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), capacity=16).collect()
    assert written == ["pieces"]
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert {r.doc_id for r in rows} == set(range(60)) and all(offset + length <= 16 for _, offset, length in taken)
    for (a, at, length), (b, to, _) in zip(taken, taken[1:]):
        assert to == (at + length if a == b else 0)


def test_pieces_that_only_the_room_beside_long_ones_holds_are_kept_for_it():
    plan = packing.plan_sequences({19: 8, 10: 12, 1: 1, 2: 1, 22: 8}, 40)
    assert max(first + n // each for _, _, n, each, first, _ in plan) <= 14
