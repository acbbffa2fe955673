"""Small helpers that the operators share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy or tokenizer call works on; keeps a Python worker's memory flat.
SLICE_BYTES = 4 << 20


def whole_text(column: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (id, text): whatever else the table holds cannot clash with an operator's own columns."""
    return df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))


def id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def slices(
    batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES, rows: int = 1 << 30
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column`` and ``rows`` rows, or of one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and (held + size > most or row - start >= rows):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def file_digest(path: str, *more: str) -> str:
    """A digest of a file's content and of further strings that decide what is made with it."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            digest.update(block)
    for part in more:
        digest.update(b"\0" + part.encode())
    return digest.hexdigest()


def character_class(kind: str, wide: bool = True) -> str:
    """The inside of an ``re`` set of all code points (up to 0xFFFF unless ``wide``) that match ``kind``."""
    import sys

    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    every = [chr(c) for c in range(sys.maxunicode + 1 if wide else 0x10000) if not 0xD800 <= c < 0xE000]
    # Asked of the library whose cuts are to be met, as every library has its own version of Unicode.
    others = set(Replace(Regex(kind), "").normalize_str("".join(every)))
    parts, first, last = [], None, None
    for letter in [c for c in every if c not in others]:
        if first is None or ord(letter) != ord(last) + 1:
            if first is not None:
                parts.append(f"{re.escape(first)}-{re.escape(last)}")
            first = letter
        last = letter
    if first is not None:
        parts.append(f"{re.escape(first)}-{re.escape(last)}")
    return "".join(parts)
