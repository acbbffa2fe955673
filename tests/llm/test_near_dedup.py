import itertools
import random

import pytest

from emberlane.llm import near_dedup
from emberlane.llm.components import components
from tests.llm.tables import TEXTS, no_documents, odd_documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return sorted(((i, len(sets[k]), smallest.get(root(k)), smallest.get(root(k)) == i) for k, (i, _) in enumerate(rows)), key=repr)


def groups(seed):
    """Copies with a few words changed, in groups of many sizes, all holding one passage."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    rows = []
    for size in (1, 2, 3, 40, 70):
        base = [word() for _ in range(90)] + passage
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.choice((0, 1, 1, 2, 3))):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(1000 + k, " ".join([*(word() for _ in range(20)), *passage])) for k in range(60)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = groups(block) + [r for r in TEXTS if r[0] is None or r[0] < 12]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, `class` int, component int")
    found = near_dedup.near_duplicates(docs, percent=85, matches=88).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr)
    wanted = [(i, n, c, k if i is not None else c is None) for i, n, c, k in brute(rows)]
    assert got == sorted(wanted, key=repr)


def test_odd_rows_and_an_empty_table(spark):
    assert near_dedup.near_duplicates(odd_documents(spark)).count() == len(TEXTS)
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (300, 301), (301, 300), (302, 301)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(table, "test").collect()}
    wanted = {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {300: 300, 301: 300, 302: 300}
    assert got == wanted
    assert components(table.filter("false"), "test").count() == 0


def test_of_rows_without_or_with_equal_ids_one_stays(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (None, text), (7, text + " end"), (7, text), (None, "another text of six words here"), (None, None), (None, None)]
    rows += [(None, "another text of six words here"), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, row_key string")
    left = near_dedup.one_of_each_group(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(i for i, t in got if (t or "").startswith("w0")) == [7]
    # Texts without words are linked with nothing; rows equal in id and text are one.
    assert [i for i, t in got if i == 3] == [3] and got.count((None, None)) == 1
    assert [i for i, t in got if (t or "").startswith("another")] == [None] and len(got) == 4
    assert near_dedup.one_of_each_group(no_documents(spark)).count() == 0
