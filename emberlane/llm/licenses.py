"""License scan by an exact set-similarity join between text blocks and notice templates.

Words of all templates are ordered by how often the whole corpus uses them, rarest first. A block that holds a share
``threshold`` of a template's words must hold one of the template's first words in that order (prefix filter), must
have enough words itself (length filter) and, from the place of the first shared word on, the template must have enough
words left (positional filter). Only pairs that pass are compared in full.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.llm.common import id_type, keyed_text, slices

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licenses, as (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

# Bytes between words become spaces; line breaks stay, as they end a block.
_SEPARATORS = bytes(
    b if b == 0x0A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def plain(text: str) -> bytes:
    """UTF-8 text with A-Z in lower case and every byte between words but line breaks turned into a space."""
    return text.encode().lower().translate(_SEPARATORS)


def word_set(text: str) -> frozenset[bytes]:
    return frozenset(plain(text).split())


def _count(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in slices(batches):
            seen = Counter(b" ".join(plain(text) for text in batch.column("text").to_pylist()).split())
            total.update({word: seen[word] for word in vocabulary if word in seen})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    return run


def word_frequencies(rows: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole corpus of each word of ``vocabulary``, which is the templates' and so small."""
    counted = rows.select("text").mapInArrow(_count(vocabulary), "word binary, n bigint")
    summed = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {word: 0 for word in vocabulary} | {bytes(r["word"]): r["n"] for r in summed}


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequencies: dict[bytes, int], threshold: float):
        self.labels = [label for label, _ in templates]
        self.words = [word_set(text) for _, text in templates]
        self.lengths = [len(plain(text).split()) for _, text in templates]
        # The least overlap; the small term keeps products such as 0.7 * 10 from rounding up.
        self.least = [max(1, math.ceil(threshold * len(words) - 1e-9)) for words in self.words]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for number, words in enumerate(self.words):
            order = sorted(words, key=lambda word: (frequencies.get(word, 0), word))
            for place, word in enumerate(order[: len(order) - self.least[number] + 1]):
                self.prefix.setdefault(word, []).append((number, place))

    def matches(self, block: frozenset[bytes]) -> list[tuple[int, float]]:
        """(template, share of its words in the block) for all that reach the threshold."""
        first: dict[int, int] = {}
        for word in block & self.prefix.keys():
            for number, place in self.prefix[word]:
                first[number] = min(place, first.get(number, place))
        found = []
        for number, place in sorted(first.items()):
            words, least = self.words[number], self.least[number]
            if len(block) < least or len(words) - place < least:
                continue
            if (shared := len(block & words)) >= least:
                found.append((number, shared / len(words)))
        return found


def _wrapped(index: TemplateIndex, lines: list[list[bytes]], first: int) -> list[tuple[int, int, float]]:
    """(line, template, share) for templates that several lines of a paragraph, which starts at line ``first``, hold.

    Between its first and its last line a run of lines may hold no more words than the template. From every line the longest such
    run is looked at, as more lines never hold less; it counts if it reaches the threshold, if it holds more than its first line
    alone, and if the run from the next line holds less. The runs' ends move on with their starts, so each line is taken in and out once.
    """
    found = []
    before = [0, *itertools.accumulate(len(line) for line in lines)]
    for number, _ in index.matches(frozenset().union(*lines)):
        words, longest = index.words[number], index.lengths[number]
        held = [words.intersection(line) for line in lines]
        inside: Counter[bytes] = Counter()
        best, end = [], 0  # the window holds the lines from the start to before ``end``
        for start in range(len(lines)):
            while end < len(lines) and (end <= start or before[end] - before[start + 1] <= longest):
                inside.update(held[end])
                end += 1
            best.append(len(inside))
            for word in held[start]:
                inside[word] -= 1
                if not inside[word]:
                    del inside[word]
        for start, n in enumerate(best):
            if n >= index.least[number] and n > len(held[start]) and (start + 1 == len(best) or n > best[start + 1]):
                found.append((first + start, number, n / len(words)))
    return found


def _places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    found = []
    for phrase, label in phrases.items():
        start = -1
        while True:
            try:
                start = words.index(phrase[0], start + 1)
            except ValueError:
                break
            if tuple(words[start : start + len(phrase)]) == phrase:
                found.append((start, label))
    return sorted(found)


_RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "matches array<struct<label: string, template: int, block: int, containment: double>>"
)


def _scan(index: TemplateIndex, phrases: dict[tuple[bytes, ...], str], wrapped: bool, schema: pa.Schema):
    starts = {phrase[0] for phrase in phrases}

    def one(text: str) -> tuple:
        flat = plain(text)
        words = flat.split()
        distinct = set(words)
        places = _places(words, phrases) if distinct & starts else []
        matches = []
        if distinct & index.prefix.keys():
            lines = [line.split() for line in flat.split(b"\n")]
            found = [(block, number, share) for block, line in enumerate(lines) for number, share in index.matches(frozenset(line))]
            if wrapped:
                for filled, run in itertools.groupby(range(len(lines)), key=lambda k: bool(lines[k])):
                    if filled and len(paragraph := list(run)) > 1:
                        found += _wrapped(index, lines[paragraph[0] : paragraph[-1] + 1], paragraph[0])
            for block, number, share in sorted(found):
                matches.append({"label": index.labels[number], "template": number, "block": block, "containment": share})
        base = {label for _, label in places}
        score = max([1.0 if places else 0.0, *(m["containment"] for m in matches)])
        return (
            len(words),
            len(places),
            places[0][0] if places else None,
            places[-1][0] if places else None,
            ",".join(sorted(base)),
            ",".join(sorted(base | {m["label"] for m in matches})),
            score,
            matches,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = zip(*(one(text) for text in batch.column("text").to_pylist()), strict=True)
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], schema=schema)

    return run


def scan_licenses(
    docs: DataFrame,
    *,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.9,
    wrapped: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    A block is a line; with ``wrapped`` it is also a run of consecutive lines with words, between whose first and last line stand no
    more words than the template has, for notices wrapped over lines: from each line the longest such run, named by that line,
    unless the run from the next line holds as much. ``matches`` names every block whose word set holds at least ``threshold`` of a template's word set;
    ``score`` is the largest such share, 1 where a phrase itself stands, else 0. ``labels`` adds the matches' labels to
    those of the phrases. Two scans: one counts the templates' words, one finds; nothing of the documents is shuffled.

    Null text counts as empty: no words, no labels, score 0. Rows with a null or repeated id stay. An empty table gives no
    rows, an empty template list leaves the phrases. Templates without words never match. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    templates = [t for t in (TEMPLATES if templates is None else templates) if word_set(t[1])]
    rows = keyed_text(docs, id_col, text_col)
    vocabulary = frozenset().union(*(word_set(text) for _, text in templates)) if templates else frozenset()
    frequencies = word_frequencies(rows, vocabulary) if vocabulary else {}
    index = TemplateIndex(templates, frequencies, threshold)
    phrases = {tuple(p.encode().split()): label for p, label in PHRASES.items()}
    ddl = f"id {id_type(rows)}, {_RESULT}"
    found = rows.mapInArrow(_scan(index, phrases, wrapped, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
    return found.withColumnRenamed("id", id_col)
