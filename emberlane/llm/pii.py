"""Personal data: fixed patterns, and a linear-chain conditional random field for what they do not cover.

The field labels white-space separated words from their shapes and neighbours. Its lattice lets only words with a digit
or an at sign be personal data; every other word is "outside", in training and in decoding. So the best path of a text
falls apart at those words into runs, which are decoded by Viterbi in numpy batches over many texts. The field is trained
from the small table in ``pii_examples``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.llm.common import id_type, keyed_text, slices
from emberlane.llm.pii_examples import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")
_OPEN = re.compile("[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.split("."))
    digits = "".join(_DIGIT.findall(match))
    return 9 <= len(digits) <= 15 if kind == "phone" else 12 <= len(digits) <= 19 and luhn(digits)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds, from the at signs: what may stand before one is read back no farther than the last match or sign."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start, end = at, None
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        floor = end or at + 1
        at = text.find("@", floor)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds, from whole chains of numbers with dots: four and four of a chain from its start on."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        start, parts = chain.start(), chain[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            yield start, start + size
            start += size + 1


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of a kind's pattern, in time that grows with the text alone.

    Two patterns would be tried from every place of a long run that lacks a dot or an at sign; they have finders of their own.
    """
    if kind == "email":
        return _emails(text)
    if kind == "ip":
        return _addresses(text)
    return (m.span() for m in PATTERNS[kind].finditer(text))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start and then kind."""
    found = []
    kinds = (("email",) if "@" in text else ()) + (("ip", "card", "phone") if _DIGIT.search(text) else ())
    for kind in kinds:
        found += [(a, b, kind) for a, b in _matches(kind, text) if _valid(kind, text[a:b])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Features ---------------------------------------------------------------------------------------------------------

LABELS = ["outside", *KINDS]
_EDGES = "\"'“”‘’<>[]{}.,;:!?"
# Words that announce personal data.
CUES = {
    "phone": "phone tel telephone mobile cell call fax téléphone telefon teléfono",
    "card": "card visa mastercard credit carte karte tarjeta",
    "ip": "ip host server address",
    "email": "email e-mail mail contact correo",
}
_CUE_OF = {word: kind for kind, words in CUES.items() for word in words.split()}
_RUNS = [(re.compile(r"[0-9]+"), lambda m: f"9{min(len(m[0]), 20)}"), (re.compile(r"[^\W\d_]+"), lambda m: "a")]


def shape(word: str) -> str:
    """What a word looks like: letter runs as ``a``, digit runs as ``9`` and their length, other characters as they are."""
    core = word.strip(_EDGES)
    for pattern, name in _RUNS:
        core = pattern.sub(name, core)
    return re.sub(r"(.)\1{2,}", r"\1\1", core)


def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(_EDGES)
    digits = "".join(_DIGIT.findall(core))
    kinds = {"letters" if core.isalpha() else "digits" if core.isdigit() else "mixed"} if core else {"empty"}
    features = ["bias", f"shape={shape(word)}", f"only={kinds.pop()}"]
    features.append(f"digits={min(len(digits), 20)}")
    if "@" in core:
        features.append("at")
    elif digits and any(c.isalpha() for c in core):
        features.append("letters and digits")
    if 12 <= len(digits) <= 19:
        features.append(f"luhn={luhn(digits)}")
    if core[:1] in "+(":
        features.append(f"first={core[:1]}")
    if cue := _CUE_OF.get(core.lower()):
        features.append(f"cue={cue}")
    return tuple(features)


def context_features(before: str | None, after: str | None) -> tuple[str, ...]:
    """Features that the words beside give; None where the text ends."""
    features = []
    for side, word in (("-1", before), ("+1", after)):
        core = "" if word is None else word.strip(_EDGES)
        if cue := _CUE_OF.get(core.lower()):
            features.append(f"{side}cue={cue}")
        if core and not core.isalpha() and _DIGIT.search(core):
            features.append(f"{side}shape={shape(word)}")
    return tuple(features)


# The field --------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    names: dict[str, int]
    emission: np.ndarray  # features x labels
    transition: np.ndarray  # from x to
    start: np.ndarray
    _known: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def _score(self, features: tuple[str, ...]) -> np.ndarray:
        rows = [self.names[f] for f in features if f in self.names]
        return self.emission[rows].sum(axis=0) if rows else np.zeros(len(LABELS))

    def word(self, word: str) -> np.ndarray:
        """A word's own scores."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 100_000:
                self._known.clear()
            known = self._score(word_features(word))
            if len(word) <= 100:
                self._known[word] = known
        return known

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def open_runs(self, text: str) -> list[list[tuple[int, int]]]:
        """Longest runs of neighbouring words (start, end in the text) that the lattice leaves open."""
        runs: list[list[tuple[int, int]]] = []
        end, size = -1, len(text)
        for hit in _OPEN.finditer(text):
            a, b = hit.span()
            if a < end:
                continue
            while a and not text[a - 1].isspace():
                a -= 1
            while b < size and not text[b].isspace():
                b += 1
            if runs and text[end:a].isspace():
                runs[-1].append((a, b))
            else:
                runs.append([(a, b)])
            end = b
        return runs

    def emissions(self, text: str, run: list[tuple[int, int]]) -> np.ndarray:
        words = [_word_before(text, run[0][0]), *(text[a:b] for a, b in run), _word_after(text, run[-1][1])]
        return np.array(
            [self.word(words[i]) + self._score(context_features(words[i - 1], words[i + 1])) for i in range(1, len(words) - 1)]
        )

    def viterbi(self, scores: list[np.ndarray], first: list[bool], last: list[bool]) -> list[np.ndarray]:
        """Best labels of runs that stand between "outside" words (or at a text's ends), many runs at once."""
        order = sorted(range(len(scores)), key=lambda r: -len(scores[r]))
        lengths = np.array([len(scores[r]) for r in order])
        best = np.stack([scores[r][0] + (self.start if first[r] else self.transition[0]) for r in order])
        back = []
        for t in range(1, lengths[0]):
            n = int((lengths > t).sum())
            paths = best[:n, :, None] + self.transition[None]
            back.append(paths.argmax(axis=1))
            best[:n] = paths.max(axis=1) + np.stack([scores[r][t] for r in order[:n]])
        leave = self.transition[:, 0]
        found: list[np.ndarray] = [np.empty(0)] * len(scores)
        for row, r in enumerate(order):
            label = int((best[row] + (0 if last[r] else leave)).argmax())
            labels = [label]
            for t in range(lengths[row] - 1, 0, -1):
                label = int(back[t - 1][row, label])
                labels.append(label)
            found[r] = np.array(labels[::-1])
        return found


def _word_before(text: str, at: int) -> str | None:
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:end] or None


def _word_after(text: str, at: int) -> str | None:
    begin = at
    while begin < len(text) and text[begin].isspace():
        begin += 1
    end = begin
    while end < len(text) and not text[end].isspace():
        end += 1
    return text[begin:end] or None


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def labelled_words(marked: str) -> tuple[list[str], list[int]]:
    """Words and labels of a line in which ``[kind: ...]`` marks personal data."""
    words, labels = [], []
    for part in re.split(r"(\[(?:" + "|".join(KINDS) + r"): [^\]]*\]\S*)", marked):
        match = re.fullmatch(r"\[(\w+): ([^\]]*)\](\S*)", part)
        if match and match[1] in KINDS:
            inner = (match[2] + match[3]).split()
            words += inner
            labels += [LABELS.index(match[1])] * len(inner)
        else:
            words += part.split()
            labels += [0] * len(part.split())
    return words, labels


def train(examples: list[str] = EXAMPLES, *, rounds: int = 300, rate: float = 0.2, ridge: float = 0.001) -> Field:
    """Maximum likelihood with a ridge penalty, by Adam, on all lines at once. The table is small and so is the field."""
    lines = [labelled_words(line) for line in examples]
    lines = [line for line in lines if line[0]]
    every = [
        [word_features(w) + context_features(ws[i - 1] if i else None, ws[i + 1] if i + 1 < len(ws) else None) for i, w in enumerate(ws)]
        for ws, _ in lines
    ]
    names: dict[str, int] = {}
    for line in every:
        for features in line:
            for name in features:
                names.setdefault(name, len(names))
    n, longest, k = len(lines), max(len(ws) for ws, _ in lines), len(LABELS)
    closed = np.zeros((n, longest, 1))
    x = np.zeros((n, longest, len(names)))
    gold = np.zeros((n, longest, k))
    there = np.zeros((n, longest), dtype=bool)
    for i, (line, (_, labels)) in enumerate(zip(every, lines, strict=True)):
        for t, features in enumerate(line):
            there[i, t] = True
            closed[i, t] = not _OPEN.search(lines[i][0][t])
            gold[i, t, labels[t]] = 1
            for name in features:
                x[i, t, names[name]] = 1
    flat = x.reshape(-1, len(names))
    weights = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    gold_steps = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
    for step in range(1, rounds + 1):
        emission, transition, start = weights
        scores = (flat @ emission).reshape(n, longest, k) - 1e6 * closed * (np.arange(k) > 0)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + start
        for t in range(1, longest):
            forward[:, t] = _log_sum(forward[:, t - 1, :, None] + transition[None], axis=1) + scores[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = _log_sum(transition[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], ahead, 0)
        ends = there.sum(axis=1) - 1
        total = _log_sum(forward[np.arange(n), ends], axis=1)
        odds = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        steps = np.zeros((k, k))
        for t in range(longest - 1):
            ahead = scores[:, t + 1] + backward[:, t + 1]
            pair = np.exp(forward[:, t, :, None] + transition[None] + ahead[:, None, :] - total[:, None, None])
            steps += (pair * there[:, t + 1, None, None]).sum(axis=0)
        slopes = [flat.T @ (gold - odds).reshape(-1, k), gold_steps - steps, (gold[:, 0] - odds[:, 0]).sum(axis=0)]
        for w, slope, (mean, square) in zip(weights, slopes, moments, strict=True):
            slope = slope / n - ridge * w
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope**2 - square)
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(names, *weights)


# Documents --------------------------------------------------------------------------------------------------------


def _field_spans(texts: list[str], crf: Field) -> list[list[Span]]:
    """Spans of the field's best labelling of each text."""
    found: list[list[Span]] = [[] for _ in texts]
    runs = [(number, run) for number, text in enumerate(texts) for run in crf.open_runs(text)]
    if not runs:
        return found
    # Where each text's first word begins and its last one ends.
    ends = [(len(text) - len(text.lstrip()), len(text.rstrip())) for text in texts]
    paths = crf.viterbi(
        [crf.emissions(texts[number], run) for number, run in runs],
        [run[0][0] == ends[number][0] for number, run in runs],
        [run[-1][1] == ends[number][1] for number, run in runs],
    )
    for (number, run), path in zip(runs, paths, strict=True):
        text, at = texts[number], 0
        while at < len(path):
            upto = at + 1
            while upto < len(path) and path[upto] == path[at]:
                upto += 1
            if path[at]:
                a, b = run[at][0], run[upto - 1][1]
                while a < b and text[a] in _EDGES:
                    a += 1
                while b > a and text[b - 1] in _EDGES:
                    b -= 1
                if a < b:
                    found[number].append((a, b, LABELS[path[at]]))
            at = upto
    return found


def all_spans(texts: list[str], crf: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base spans and those of the field that overlap none of them) for each text, in order."""
    result = []
    for text, added in zip(texts, _field_spans(texts, crf), strict=True):
        base = base_spans(text)
        new, at, reach = [], 0, 0
        # Both by start: a new span is free if no base span that starts before its end reaches beyond its start.
        for span in sorted(added):
            while at < len(base) and base[at][0] < span[1]:
                reach = max(reach, base[at][1])
                at += 1
            if reach <= span[0]:
                new.append(span)
        result.append((base, sorted(base + new, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return result


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; where spans overlap, the earlier and longer one counts."""
    parts, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:  # a span that reaches beyond the one before it
            at = end
    return "".join([*parts, text[at:]])


_FOUND = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, masked string"
)


def _find(crf: Field, schema: pa.Schema, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            rows = []
            for text, (base, spans) in zip(texts, all_spans(texts, crf), strict=True):
                counts = [sum(s[2] == kind for s in base) for kind in KINDS]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                # Only a text that holds spans is written out again.
                rows.append((*counts, digest, joined(spans), masked(text, spans) if with_text and spans else None))
            arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], schema=schema)

    return run


def find_personal_data(
    docs: DataFrame, *, crf: Field | None = None, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked.

    Counts and digest are of the base patterns alone; ``spans`` (kind:start:end in code points, by start) adds what the
    field finds beside them. ``masked`` is the text with all spans replaced, null where there are none or without
    ``with_text``. Whole texts are read where they lie; nothing is shuffled.

    Null text counts as empty: no spans. Rows with a null or repeated id stay. An empty table gives no rows. Other
    columns are not read.
    """
    rows = keyed_text(docs, id_col, text_col)
    ddl = f"id {id_type(rows)}, {_FOUND}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return rows.mapInArrow(_find(crf or train(), schema, with_text), ddl).withColumnRenamed("id", id_col)


def mask_rows(
    docs: DataFrame, *, crf: Field | None = None, text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """The rows of ``docs`` with all spans in the text replaced by their kind, and the length column to match.

    Rows without spans, null texts among them, stay as they are, and so do all other columns; nothing is shuffled.
    """
    crf = crf or train()
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = batch.column(place).to_pylist()
            found = all_spans([t or "" for t in texts], crf)
            new = [masked(t, spans) if spans else t for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, columns[place].type)
            if length is not None:
                old = columns[length].to_pylist()
                sizes = [len(t) if spans else n for t, n, (_, spans) in zip(new, old, found, strict=True)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
