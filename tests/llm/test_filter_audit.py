import itertools
import random
import re

from emberlane.llm import filter_audit
from tests.llm.tables import TEXTS, no_documents, odd_documents


def failures(rows):
    """Per row: the letters of the filters that it fails."""
    found = []
    for i, text, _ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = "A" if len(words) < 50 else ""
        fails += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
        fails += "D" if re.search("[#$%&*|]", text) else ""
        fails += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else ""
        found.append(fails)
    return found


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, result = failures(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shares[letter] += len(gone)
                result[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ]
        for key in result:
            if key[0] == part:
                result[key][-1] = shares[result[key][-1]]
    return {k: tuple(v) for k, v in result.items()}


def got(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_equal_to_trying_every_order(spark):
    draw = random.Random(3)
    word = lambda: draw.choice(["aa", "Bb", "CCC", "d#", "e", "f", "\x1c", "é", "x$"])
    texts = [" ".join(word() for _ in range(draw.choice((0, 3, 60, 80)))) for _ in range(25)] + [None, "", "A", "a b"]
    texts += [" ".join(f"w{k}" for k in range(70)), " ".join(f"W{k}" for k in range(70))]
    rows = [(k, draw.choice(texts), draw.choice(["s", "t", None, ""])) for k in range(150)]
    rows += [(None, texts[0], "s"), (None, texts[0], "s"), (7, texts[1], "u"), (7, texts[1], "u")]
    draw.shuffle(rows)
    labels = [(draw.choice([*range(40), None, 999]), draw.choice((0, 1, None)), draw.choice((0, 1, None))) for _ in range(80)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, source string, failed int, content string")
    table = spark.createDataFrame([(*r, "y") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    assert got(filter_audit.audit_filters(docs.repartition(5), table)) == brute(rows, labels)


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(i, t, f"s{k % 2}") for k, (i, t) in enumerate(TEXTS)]
    assert got(filter_audit.audit_filters(odd_documents(spark), labels)) == brute(rows, [])
    assert filter_audit.audit_filters(no_documents(spark), labels).count() == 0


def test_values_are_the_mean_of_all_orders():
    draw = random.Random(5)
    for players in (2, 3, 5):
        worth = [0] + [draw.randrange(-50, 10**12) for _ in range(2**players - 1)]
        sums = [0] * players
        orders = list(itertools.permutations(range(players)))
        for order in orders:
            before = 0
            for k in order:
                sums[k] += worth[before | 1 << k] - worth[before]
                before |= 1 << k
        assert [v * len(orders) for v in filter_audit.shapley_values(worth, players)] == sums
