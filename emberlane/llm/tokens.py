"""Exact ids of the byte-level BPE vocabulary, fast enough for a scan over the corpus.

The vocabulary file gives the merge ranks. A text without two white-space characters in a row is cut by
a pattern free of look-ahead, which a linear-time matcher runs; any other text by the full pattern. Both cut
such a text alike. A text that holds a special token's string goes to the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import re

_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
_RUNS = re.compile(r"\s\s")


class ByteBpe:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {character: byte for byte, character in enumerate(byte_letters())}
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): number
            for token, number in spec["model"]["vocab"].items()
            if token not in special
        }
        make = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={})
        # The bare core leaves out a second try for lone surrogates, which Arrow strings cannot hold.
        self._plain = make("plain", pat_str=_WORDS + r"|\s")._core_bpe.encode_ordinary
        self._full = make("full", pat_str=_WORDS + r"|\s+(?!\S)|\s+")._core_bpe.encode_ordinary
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._library = Tokenizer.from_file(path) if special else None
        if self._library:
            self._library.no_truncation()
            self._library.no_padding()

    def encode(self, text: str) -> list[int]:
        if self._special and self._special.search(text):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._full(text) if _RUNS.search(text) else self._plain(text)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(path)


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1 characters stand for
    themselves, the other bytes take the code points from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(byte if byte in visible else next(hidden)) for byte in range(256)]
