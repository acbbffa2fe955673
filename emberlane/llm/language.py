"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.llm.common import id_type, keyed_text, slices, whole_text

UNKNOWN = "und"
#: Hashed byte pairs and triples share this many places.
DIMENSIONS = 4096
#: A text of few terms lies far from any centroid whatever its language. So the distance that is still accepted falls
#: from ``SHORT_RADIUS`` to the language's own radius, half-way at ``HALF_WAY`` distinct terms.
SHORT_RADIUS = 0.98
HALF_WAY = 100
# One call's texts: the arrays beside them take some sixty times their bytes.
_ROWS = 500
_BYTES = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
# Lower-case letters and all bytes of non-ASCII characters stay, the rest becomes a space.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(texts: list[str]) -> np.ndarray:
    """One row of hashed n-gram counts for each whole text; n-grams of spaces alone are left out."""
    flat = [t.encode().lower().translate(_LETTERS) for t in texts]
    ends = np.cumsum([len(t) + 3 for t in flat])
    data = np.frombuffer(b"   ".join(flat) + b"   ", dtype=np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(flat), dtype=np.int64), [len(t) + 3 for t in flat])
    assert len(data) == ends[-1]
    counts = np.zeros(len(flat) * DIMENSIONS, dtype=np.int64)
    for n in (2, 3):
        code = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
        blank = code == sum(0x20 << 8 * k for k in range(n))
        # An n-gram that begins in one text's trailing blanks and ends in the next text belongs to neither.
        own = ~blank & (row[: len(code)] == row[n - 1 :])
        place = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
        keys = row[: len(code)] * DIMENSIONS + place
        counts += np.bincount(keys[own], minlength=len(counts))
    return counts.reshape(len(flat), DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length 1 (or 0 without terms) of dampened counts times idf."""
    vectors = np.log1p(counts).astype(np.float32) * idf.astype(np.float32)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def shortness(counts: np.ndarray) -> np.ndarray:
    """The share of the way from a language's radius to ``SHORT_RADIUS`` that a text of so few terms is allowed; below 1."""
    return HALF_WAY / (HALF_WAY + np.maximum(1, (counts > 0).sum(axis=1)))


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray  # of each centroid: cosine distance beyond which a text is rejected
    idf: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, cosine in [0, 1], accepted) for each text; no letter gives (und, 0, False)."""
        if not texts:
            return []
        if not self.languages:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        counts = term_counts(texts)
        short = shortness(counts)
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        found = []
        for i, text in enumerate(texts):
            if not _LETTER.search(text):
                found.append((UNKNOWN, 0.0, False))
                continue
            near = float(min(1.0, max(0.0, cosine[i, best[i]])))
            radius = self.radius[best[i]]
            allowed = radius + max(0.0, SHORT_RADIUS - radius) * short[i]
            found.append((self.languages[best[i]], near, bool(1 - near <= allowed)))
        return found


def _clusters(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from a start that takes, again and again, the vector farthest from those taken."""
    centers = vectors[:1]
    while len(centers) < min(k, len(vectors)):
        nearest = (vectors @ centers.T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centers = np.vstack([centers, vectors[nearest.argmin()]])
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centers))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


def _training_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=_BYTES, rows=_ROWS):
        counts = term_counts(batch.column("text").to_pylist()).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "counts"]
        )


def fit(
    labelled: DataFrame,
    *,
    rows_per_language: int = 250,
    clusters: int = 4,
    rounds: int = 8,
    quantile: float = 0.99,
    slack: float = 0.25,
    languages: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on at most ``rows_per_language`` labelled rows of each language, chosen by a hash of the id.

    That bound is what the driver holds: so many vectors of ``DIMENSIONS`` counts for each of the ``languages`` most frequent labels. Rows whose language
    or text is null or whose text has no letter teach nothing. A language rejects what is farther away than a share
    ``quantile`` of its training rows, each judged by its length, plus ``slack``. Without usable rows the model knows no language.
    """
    sizes = labelled.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(languages)
    shares = [x for r in sizes.collect() for x in (F.lit(r["lang"]), F.lit((3 * rows_per_language + 50) / r["n"]))]
    # A first draw leaves about thrice the wanted rows, so that the exact choice below ranks a bounded number of rows.
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / (1 << 30)
    # A label that is not among them has no share, and no row of it is drawn.
    share = F.create_map(*shares)[F.col(lang_col)] if shares else F.lit(0.0)
    drawn = labelled.filter(F.col(lang_col).isNotNull() & (draw < share)).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), whole_text(text_col).alias("text"), draw.alias("draw")
    )
    drawn = drawn.filter(F.col("text").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    chosen = drawn.withColumn("place", place).filter(F.col("place") <= rows_per_language).select("lang", "text")
    rows = chosen.mapInArrow(_training_vectors, "lang string, counts binary").collect()
    if not rows:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS))
    rows.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    langs = np.array([r["lang"] for r in rows])
    counts = np.stack([np.frombuffer(r["counts"], dtype=np.int32) for r in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    vectors = weighted(counts, idf)
    names: list[str] = []
    centers, radius = [], []
    for lang in sorted(set(langs)):
        own = vectors[langs == lang]
        found = _clusters(own, clusters, rounds)
        cosine = own @ found.T
        nearest = cosine.argmax(axis=1)
        # The radius that would just accept each row, what a text of its length is allowed on top taken off. A language's
        # clusters share one: which of them lies nearest to an odd text is chance.
        short = shortness(counts[langs == lang])
        needed = (1 - cosine[np.arange(len(own)), nearest] - SHORT_RADIUS * short) / (1 - short)
        far = max(0.0, float(np.quantile(needed, quantile)))
        names += [str(lang)] * len(found)
        centers += list(found)
        radius += [far + slack] * len(found)
    return LanguageModel(names, np.stack(centers).astype(np.float32), np.array(radius), idf)


def _predict(model: LanguageModel, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_BYTES, rows=_ROWS):
            lang, score, kept = zip(*model.predict(batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], schema=schema
            )

    return run


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (cosine, 0 to 1), accepted (close enough to the language's training rows).

    Reads the text alone, whole, where it lies; nothing is shuffled. Null text, and text without a letter, gives
    ``und``, 0 and not accepted, as does any text if the model knows no language. Of equally near centroids the first in
    order of language wins. Rows with a null or repeated id stay. An empty table gives no rows.
    """
    rows = keyed_text(docs, id_col, text_col)
    ddl = f"id {id_type(rows)}, lang_pred string, score double, accepted boolean"
    return rows.mapInArrow(_predict(model, to_arrow_schema(StructType.fromDDL(ddl))), ddl).withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model accepts; nothing is shuffled.

    Null texts and texts without a letter go, as ``identify`` accepts none of them.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place, most=_BYTES, rows=_ROWS):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([kept for _, _, kept in model.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
