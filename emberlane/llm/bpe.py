"""Exact BPE by backtracking over longest token matches, and decoding through an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import character_class, id_type, keyed_text, slices
from emberlane.llm.tokens import byte_letters

#: A Python worker remembers the ids of this many words, and of as many that it met before those.
REMEMBERED_WORDS = 250_000
_NEVER = 1 << 60


class WordBpe:
    """A lower-casing word vocabulary with word ends, read from a tokenizers file.

    A sequence of tokens is what the merges would give exactly when each token stands beside a neighbour it is compatible
    with: no merge across their border comes before the merges that made the two. So a word is encoded by taking the
    longest token at each place (all matches come from one Aho-Corasick pass), checking it against the token before it
    and, where no token goes on from a place, stepping back and marking that place as dead.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._mark = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._rank: dict[tuple[int, int], int] = {}
        self._made_of: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocabulary[left], vocabulary[right]
            self._rank[pair] = rank
            self._made_of[vocabulary[left + right]] = (*pair, rank)
        made = set(self._made_of)
        self._matches = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            spelled = self._spell(token)
            # A token that is neither a single symbol nor made by a merge never comes out of merging.
            if number in made or len(spelled) == 1:
                self._matches.add_word(spelled, (number, len(spelled)))
        self._matches.make_automaton()
        self._letters = byte_letters()
        names = sorted({**vocabulary, **self.special}.items(), key=lambda item: item[1])
        self._spelling = b"".join(token.encode() for token, _ in names)
        size = 1 + max(number for _, number in names)
        lengths = np.zeros(size, dtype=np.int64)
        for token, number in names:
            lengths[number] = len(token.encode())
        self._starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._compatible: dict[int, bool] = {}
        self._remembered: dict[str, tuple[bytes, bytes]] = {}
        self._older: dict[str, tuple[bytes, bytes]] = {}
        self._parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _spell(self, token: str) -> str:
        """One character for each symbol: a letter that ends a word moves to a plane of its own."""
        if token.endswith(self._mark) and len(token) > len(self._mark):
            body = token[: -len(self._mark)]
            return body[:-1] + chr(0x10000 + ord(body[-1]))
        return token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost symbol up to the token: (part at its border, rank of the merge that uses the part up)."""
        key = (token, side)
        if key not in self._spines:
            up, part, ends = [], token, _NEVER
            while True:
                up.append((part, ends))
                if part not in self._made_of:
                    break
                *halves, ends = self._made_of[part]
                part = halves[side]
            self._spines[key] = up[::-1]
        return self._spines[key]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two neighbouring tokens alone."""
        known = self._compatible.get(left << 20 | right)
        if known is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[left << 20 | right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        ends, starts = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            across = self._rank.get((a, b), _NEVER)
            # Of equal merges the leftmost comes first: one inside the left token before, one inside the right after.
            if across < a_until and across <= b_until and across != _NEVER:
                return False
            if a_until == b_until == _NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _encode_word(self, word: str) -> list[int]:
        letters = self._letters
        spelled = "".join([letters[b] for b in word.encode()])
        spelled = spelled[:-1] + chr(0x10000 + ord(spelled[-1]))
        size = len(spelled)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, match in self._matches.iter(spelled):
            starting[end + 1 - match[1]].append(match)  # ends rise, so the longest is last
        if len(starting[0][-1:]) and starting[0][-1][1] == size:
            return [starting[0][-1][0]]
        tokens: list[int] = []
        # For each token taken: where it starts and the shorter ones left to try there.
        trail: list[tuple[int, list[tuple[int, int]]]] = []
        dead: set[int] = set()
        known = self._compatible.get
        place, tries, last = 0, starting[0], -1
        while True:
            while tries:
                number, length = tries.pop()
                if place + length not in dead:
                    fits = last < 0 or known(last << 20 | number)
                    if fits or (fits is None and self.compatible(last, number)):
                        break
            else:
                dead.add(place)
                tokens.pop()
                place, tries = trail.pop()
                last = tokens[-1] if tokens else -1
                continue
            tokens.append(number)
            trail.append((place, tries))
            place += length
            if place == size:
                return tokens
            tries, last = list(starting[place]), number

    def word(self, word: str) -> tuple[bytes, bytes]:
        """A word's ids as bytes and its tokens joined by spaces."""
        known = self._older.get(word)
        if known is None:
            ids = self._encode_word(word)
            known = struct.pack(f"<{len(ids)}I", *ids), self.spell(ids)
        if len(self._remembered) >= REMEMBERED_WORDS:
            self._older = self._remembered
            self._remembered = {}
        self._remembered[word] = known
        return known

    def spell(self, ids: list[int]) -> bytes:
        """The tokens of ``ids`` joined by spaces, cut from one buffer by the offset table."""
        text, starts = self._spelling, self._starts
        return b" ".join([text[starts[i] : starts[i + 1]] for i in ids])

    def encode(self, text: str) -> tuple[bytes, bytes, int]:
        """(ids as little-endian unsigned 32-bit numbers, decoded text in UTF-8, number of ids)."""
        ids: list[bytes] = []
        spelled: list[bytes] = []
        for part in self._parts.split(text) if self._parts else [text]:
            if part in self.special:
                made = [(self.special[part].to_bytes(4, "little"), part.encode())]
            else:
                plain = normalised(part)
                wide = len(plain.encode("utf-16-le")) > 2 * len(plain)
                remembered, word = self._remembered.get, self.word
                made = [remembered(item) or word(item) for item in word_pattern(wide).findall(plain)]
            ids += [a for a, _ in made]
            spelled += [b for _, b in made]
        joined = b"".join(ids)
        return joined, b" ".join(spelled), len(joined) // 4

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids).decode()


@functools.cache
def word_pattern(wide: bool) -> re.Pattern:
    """The vocabulary's cut into words; ``wide`` for texts with code points past 0xFFFF, whose sets match far slower."""
    letters, numbers, space = (character_class(kind, wide) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}{space}]+")


def normalised(text: str) -> str:
    """Composed and lower-cased character by character: a final sigma is not treated apart.

    Scripts to which newer versions of Unicode add letters are left to the library, which may know more of them than Python.
    """
    if text.isascii():
        return text.lower()
    if _LATER.search(text):
        return _library_normaliser().normalize_str(text)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_LATER = re.compile("[\u0530-\u1fff\u2c00-\U0010ffff]")


@functools.cache
def _library_normaliser():
    from tokenizers.normalizers import NFC, Lowercase, Sequence

    return Sequence([NFC(), Lowercase()])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One encoder for each Python worker."""
    return WordBpe(path)


def _run(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path).encode
        for batch in slices(batches):
            made = [encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([n for _, _, n in made], pa.int64()),
                    pa.array([ids for ids, _, _ in made], pa.binary()),
                    pa.array([text for _, text, _ in made], pa.binary()),
                ],
                schema=schema,
            )

    return run


def _digest(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path).encode
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids, spelled, n = encode(text)
                rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(spelled).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=schema)

    return run


def _over(docs: DataFrame, make, ddl: str, path: str, id_col: str, text_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = keyed_text(docs, id_col, text_col)
    ddl = f"id {id_type(rows)}, {ddl}"
    return rows.mapInArrow(make(path, to_arrow_schema(StructType.fromDDL(ddl))), ddl).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary, UTF-8).

    Ids are those of the tokenizers library without added special tokens, truncation or padding; decoded is what its
    decode() gives for them, special tokens included. Nothing is shuffled; a text is encoded whole. Null text counts
    as empty (no ids, empty decoding). Rows with a null or repeated id stay. An empty table gives no rows. Other columns
    are not read.
    """
    return _over(docs, _run, "n_tokens bigint, ids binary, decoded binary", tokenizer_path, id_col, text_col)


def encode_digests(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests (hex) in place of ids and decoding: ids_sha256, decoded_sha256."""
    return _over(docs, _digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", tokenizer_path, id_col, text_col)


def decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text, the decoding of ``ids_col`` (binary as ``encode`` writes it; null gives null)."""

    @F.pandas_udf("string")
    def text_of(column):
        spell = word_bpe(tokenizer_path).decode
        return column.map(lambda raw: None if raw is None else spell(np.frombuffer(raw, dtype="<u4").tolist()))

    return encoded.select(F.col(id_col), text_of(F.col(ids_col)).alias("text"))
