import random
import re
import textwrap

import pytest

from emberlane.llm import licenses
from tests.llm.tables import TEXTS, no_documents, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_runs(flat, templates, threshold):
    """All runs of lines of a paragraph, tried one by one."""
    lines = [WORD.findall(line) for line in flat.split("\n")]
    found = set()
    for number, (label, template) in enumerate(templates):
        wanted, size = set(WORD.findall(lower(template))), len(WORD.findall(lower(template)))

        def most(start, wanted=wanted, size=size):
            best = 0
            for end in range(start, len(lines)):
                if not lines[end]:
                    break
                if sum(map(len, lines[start + 1 : end])) > size:
                    break
                best = max(best, len(wanted & {w for line in lines[start : end + 1] for w in line}))
            return best

        for start in range(len(lines)):
            if lines[start]:
                n, later = most(start), most(start + 1) if start + 1 < len(lines) and lines[start + 1] else 0
                if n >= threshold * len(wanted) - 1e-9 and n > len(wanted & set(lines[start])) and n > later:
                    found.add((label, number, start, n / len(wanted)))
    return found


def brute(text, templates, threshold, wrapped=False):
    flat = lower(text or "")
    words = WORD.findall(flat)
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    matches = set()
    for block, line in enumerate(flat.split("\n")):
        have = set(WORD.findall(line))
        for number, (label, template) in enumerate(templates):
            wanted = set(WORD.findall(lower(template)))
            if len(wanted & have) >= threshold * len(wanted) - 1e-9:
                matches.add((label, number, block, len(wanted & have) / len(wanted)))
    if wrapped:
        matches |= brute_runs(flat, templates, threshold)
    base = {label for _, label in places}
    starts = sorted(i for i, _ in places)
    return (
        len(words),
        len(places),
        starts[0] if starts else None,
        starts[-1] if starts else None,
        ",".join(sorted(base)),
        ",".join(sorted(base | {m[0] for m in matches})),
        max([1.0 if places else 0.0, *(m[3] for m in matches)]),
        matches,
    )


@pytest.mark.parametrize("wrapped", [False, True])
@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_scan_equals_brute_force(spark, threshold, wrapped):
    draw = random.Random(5)
    rows = list(TEXTS)
    for k in range(120):
        lines = []
        for _ in range(draw.randint(1, 4)):
            words = draw.choice(licenses.TEMPLATES)[1].split()
            line = " ".join(w for w in words + ["mit", "License", "x1"] if draw.random() < 0.85)
            lines += textwrap.wrap(line, draw.choice((20, 60, 1000))) + draw.choice(([], [""], ["***"], ["the software"]))
        rows.append((100 + k, "\n".join(lines)))
    docs = spark.createDataFrame([(k, t, 1) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string, word int")
    for r in licenses.scan_licenses(docs, threshold=threshold, wrapped=wrapped).collect():
        matches = {(m.label, m.template, m.block, m.containment) for m in r.matches}
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, matches)
        assert got == brute(rows[r.doc_id][1], licenses.TEMPLATES, threshold, wrapped)


def test_odd_rows_and_no_templates(spark):
    assert licenses.scan_licenses(odd_documents(spark)).count() == len(TEXTS)
    assert licenses.scan_licenses(no_documents(spark)).count() == 0
    bare = {r.doc_id: r.labels for r in licenses.scan_licenses(odd_documents(spark), templates=[("x", " - ")]).collect()}
    assert bare[0] == "mit" and bare[1] == ""


@pytest.mark.parametrize("width", [30, 70, 80])
@pytest.mark.parametrize("leader", ["", " * ", "# "])
def test_notices_wrapped_over_lines(spark, width, leader):
    rows = [
        (k, "\n".join(leader + line for line in ["int x;", "", *textwrap.wrap(text, width), "", "int y;"]))
        for k, (_, text) in enumerate(licenses.TEMPLATES)
    ]
    # The words of a notice spread over a long text are no notice.
    spread = "\n".join(f"{w} " + " ".join(f"w{i}x{j}" for j in range(30)) for i, w in enumerate(licenses.TEMPLATES[7][1].split()))
    docs = spark.createDataFrame([*rows, (99, spread)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, wrapped=True).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k].labels.split(",") and got[k].score == 1.0
    assert got[99].labels == ""
