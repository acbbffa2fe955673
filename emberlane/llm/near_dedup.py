"""Near-duplicate documents by an inverted join on signature coordinates, links confirmed on full shingle sets.

1. Texts become sets of five-word shingles; equal sets are one class. A class has a MinHash signature.
2. A class is posted under (coordinate, value) pairs. Two sets over the similarity agree in ``matches`` of all coordinates
   but for a chance of about one in a million, and so share one of each other's first ``coordinates - matches + 1`` pairs
   in any order that all classes use (prefix filter). Pairs that very many classes share come last in that order.
3. In every posting list each class is compared with the list's first class. Lists in which classes stay apart
   after that are compared further, short ones pair by pair, long ones in blocks; each set of lists with the same
   classes once. Only signatures are compared, and a block gives no more than what ties its classes together.
4. Classes tied so far form small groups. Their sets are compared exactly, in blocks, and tied by confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.llm.common import id_type, keyed_text, slices
from emberlane.llm.components import components
from emberlane.llm.shingles import shingle_sets, signatures
from emberlane.session import materialise

#: Posting lists up to this length are compared pair by pair, longer ones in blocks.
SHORT_LIST = 16
BLOCK = 256
#: Pairs of coordinate and value that go last in the order: at most so many, each in so large a share of some partition.
HEAVY_PAIRS = 20_000
HEAVY_SHARE = 0.005
_SLICE = 1 << 20


def _binary(rows) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _prints(coordinates: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            sets = shingle_sets(batch.column("text").to_pylist())
            filled = [s for s in sets if len(s)]
            found = iter(signatures(filled, coordinates))
            sig = [next(found).tobytes() if len(s) else None for s in sets]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                schema=schema,
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), -1)


def _pairs(sig: np.ndarray) -> np.ndarray:
    """(coordinate, value) as one number."""
    return (np.arange(sig.shape[1], dtype=np.int64) << 32) | sig.astype(np.int64)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that a large share of this partition's classes has; one coordinate's pairs are counted at a time."""
    sigs = [_matrix(batch.column("sig")) for batch in batches if batch.num_rows]
    if sigs:
        sig = np.concatenate(sigs)
        least = max(3, int(len(sig) * HEAVY_SHARE))
        for k in range(sig.shape[1]):
            value, n = np.unique(sig[:, k], return_counts=True)
            keep = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array((k << 32) | value[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], names=["pair", "n"]
            )


def _posted(heavy: list[int], prefix: int):
    """``heavy``: from the most frequent pair on."""
    sorted_heavy = np.array(sorted(heavy), dtype=np.int64)
    place = np.empty(len(heavy), dtype=np.int64)
    place[np.searchsorted(sorted_heavy, np.array(heavy, dtype=np.int64))] = np.arange(len(heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = _pairs(_matrix(batch.column("sig")))
            # Rare pairs in an order of their own hash, heavy ones after them, the heaviest last.
            order = (pairs * 0x2545F4914F6CDD1D) & ((1 << 62) - 1)
            if len(heavy):
                at = np.minimum(np.searchsorted(sorted_heavy, pairs), len(heavy) - 1)
                order = np.where(sorted_heavy[at] == pairs, (1 << 62) + len(heavy) - place[at], order)
            first = np.argpartition(order, prefix - 1, axis=1)[:, :prefix]
            chosen = np.take_along_axis(pairs, first, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.ravel()), pa.array(np.repeat(batch.column("class").to_numpy(), prefix))], names=["pair", "class"]
            )

    return run


def _agreeing(matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).sum(axis=1) >= matches
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same))

    return run


def compared(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Those of the class pairs (a, b) whose signatures agree often enough."""
    sig = classes.select("class", "sig")
    both = pairs.join(sig.withColumnsRenamed({"class": "a", "sig": "sig_a"}), "a").join(
        sig.withColumnsRenamed({"class": "b", "sig": "sig_b"}), "b"
    )
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(matches), "a bigint, b bigint")


class _Ties:
    """Which of a block's members are tied already."""

    def __init__(self, names: list[int]):
        self.parent = {n: n for n in names}

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _agreeing_rows(sig: np.ndarray, matches: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows that agree with it often enough."""
    for i in range(len(sig) - 1):
        later = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= matches) + i + 1
        if len(later):
            yield i, later


def _tie_signatures(matches: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # A pair of blocks holds either block's rows; what lies in one block alone is repeated there, and tied once.
        sig = np.frombuffer(b"".join(block["sig"]), dtype=np.uint32).reshape(len(block), -1)
        names, groups = block["class"].tolist(), block["component"].tolist()
        ties, edges = _Ties(groups), []
        for i, later in _agreeing_rows(sig, matches):
            edges += [(names[i], names[j]) for j in later if ties.tie(groups[i], groups[j])]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _tie_sets(matches: int, percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(block["sig"]), dtype=np.uint32).reshape(len(block), -1)
        names = block["class"].tolist()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in block["shingles"]]
        ties, edges = _Ties(names), []
        for i, later in _agreeing_rows(sig, matches):
            for j in later:
                a, b = sets[i], sets[j]
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or ties.root(names[i]) == ties.root(names[j]):
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    ties.tie(names[i], names[j])
                    edges.append((names[i], names[j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def in_block_pairs(rows: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with (left, right): every pair of blocks that a row takes part in, so that any two rows of a key meet.

    A key of ``size`` rows has size / BLOCK blocks; a row is copied once for each of them.
    """
    blocks = F.ceil(F.col(size) / BLOCK)
    own = F.pmod(F.xxhash64(F.col("class"), F.lit(7)), blocks)
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("left", F.least("own", "other"))
        .withColumn("right", F.greatest("own", "other"))
        .drop("own", "other", size)
    )


def _sets(coordinates: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            sets = shingle_sets(batch.column("text").to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            # A row that shares the id of a class's first document, but not its text, does not stand for the class.
            keep = [i for i, wanted in enumerate(batch.column("digest").to_pylist()) if digests[i] == wanted]
            sets = [sets[i] for i in keep]
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("class"), kept.column("component"), kept.column("n_classes"), _binary(signatures(sets, coordinates)), _binary(sets)],
                schema=schema,
            )

    return run


def coarse_edges(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Edges (a, b) that tie all classes whose signatures agree in ``matches`` coordinates; see the module's steps 2 and 3."""
    counted = classes.select("sig").mapInArrow(_heavy, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    heavy = [r["pair"] for r in counted.orderBy(F.desc("n"), "pair").limit(HEAVY_PAIRS).collect()]
    posted = classes.select("class", "sig").mapInArrow(_posted(heavy, coordinates - matches + 1), "pair bigint, class bigint")
    lists = posted.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("class").alias("first"),
        F.bit_xor(F.xxhash64("class")).alias("mark"),
        F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("mark2"),
    ).filter("n > 1")
    # Of lists with the same classes one is enough.
    lists = materialise(lists.groupBy("n", "first", "mark", "mark2").agg(F.min("pair").alias("pair")).select("pair", "n", "first"), "lists")
    members = materialise(posted.join(lists, "pair").select("pair", "class", "n", "first"), "members")

    stars = members.filter(F.col("class") != F.col("first")).select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    edges = materialise(compared(stars, classes, matches), "star-edges")
    tied = components(edges, "stars").withColumnRenamed("node", "class")
    longer = members.filter("n > 2").join(tied, "class", "left")
    longer = materialise(longer.select("pair", "class", "n", F.coalesce("component", "class").alias("component")), "list-components")
    apart = longer.groupBy("pair").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    apart = materialise(longer.join(apart.select("pair"), "pair", "left_semi"), "lists-apart")

    short = apart.filter(F.col("n") <= SHORT_LIST)
    other = short.select("pair", F.col("class").alias("b"), F.col("component").alias("other"))
    pairs = short.join(other, "pair").filter((F.col("class") < F.col("b")) & (F.col("component") != F.col("other")))
    pairs = pairs.select(F.col("class").alias("a"), "b").distinct()
    edges = edges.unionByName(compared(pairs, classes, matches))

    long = in_block_pairs(apart.filter(F.col("n") > SHORT_LIST), "pair", "n").join(classes.select("class", "sig"), "class")
    blocks = long.groupBy("pair", "left", "right").applyInPandas(_tie_signatures(matches), "a bigint, b bigint")
    return edges.unionByName(blocks)


def near_duplicates(
    docs: DataFrame,
    *,
    percent: int = 80,
    coordinates: int = 128,
    matches: int = 79,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links, its own included), kept (id is that one).

    Two rows are linked if 100 times their sets' intersection is at least ``percent`` times their union. A pair is found
    if its signatures agree in ``matches`` of ``coordinates`` coordinates; at a similarity of 0.80 that fails about once in a
    million pairs for the default values, and whoever changes ``percent`` changes ``matches`` too (88 for 85).

    Null text counts as empty. A text without words has no shingles and is linked with nothing: its component is its own
    id. Rows with equal ids stay and are rows of their own; ids are compared as numbers or strings, nulls are never the
    smallest. A null id without links has a null component and is kept. An empty table gives no rows. Other columns are
    not read.
    """
    if not 0 < matches <= coordinates:
        raise ValueError("matches must lie between 1 and coordinates")
    rows = keyed_text(docs, id_col, text_col)
    kind = id_type(rows)
    ddl = f"id {kind}, n_shingles bigint, digest binary, sig binary"
    prints = materialise(rows.mapInArrow(_prints(coordinates, to_arrow_schema(StructType.fromDDL(ddl))), ddl), "prints")
    classes = prints.filter("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("first_id"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    edges = materialise(coarse_edges(classes, coordinates, matches), "coarse-edges")
    tied = components(edges, "coarse").withColumnRenamed("node", "class")
    groups = tied.groupBy("component").agg(F.count(F.lit(1)).alias("n_classes"))
    wanted = materialise(
        tied.join(groups, "component").join(classes.select("class", "digest", "first_id"), "class"), "compared-classes"
    )
    texts = rows.join(wanted.hint("shuffle_hash"), rows["id"].eqNullSafe(wanted["first_id"]))
    ddl = "class bigint, component bigint, n_classes bigint, sig binary, shingles binary"
    sets = texts.select("text", "digest", "class", "component", "n_classes").mapInArrow(
        _sets(coordinates, to_arrow_schema(StructType.fromDDL(ddl))), ddl
    )
    blocks = in_block_pairs(sets, "component", "n_classes").groupBy("component", "left", "right")
    links = materialise(blocks.applyInPandas(_tie_sets(matches, percent), "a bigint, b bigint"), "links")

    linked = components(links, "links").withColumnRenamed("node", "class")
    named = linked.join(classes.select("class", "digest", "first_id"), "class")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialise(named.join(smallest, "component").select("digest", "component_id"), "linked-classes")
    alone = classes.select("digest", F.col("first_id"))
    of_class = materialise(
        alone.join(named, "digest", "left").select("digest", F.coalesce("component_id", "first_id").alias("component_id")), "class-components"
    )
    found = prints.select("id", "n_shingles", "digest").join(of_class, "digest", "left")
    found = found.select(F.col("id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def one_of_each_group(
    docs: DataFrame, *, percent: int = 80, coordinates: int = 128, matches: int = 79, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay: of each group of linked rows the one with the smallest id.

    A row is told by its id and a digest of its text, so that of rows with equal ids one stays too, and rows without an id (the last
    choice in a group) are kept and dropped like any others; rows equal in both are one. Texts without words are linked with
    nothing: they stay, once for each id. The texts are not copied; the kept rows are fetched by one join.
    """
    names = ("no_id", "id", "digest")
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(*[c.alias(n) for c, n in zip((F.col(id_col).isNull(), F.col(id_col), digest), names, strict=True)])
    told = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(told, percent=percent, coordinates=coordinates, matches=matches, id_col="key", text_col="text").filter("kept")
    # Plain columns without nulls: the join and the window after it use one shuffle.
    flat = lambda c: (c["no_id"], F.coalesce(c["id"].cast("string"), F.lit("")), c["digest"])
    own = [next(f"{n}_{'_' * k}" for k in range(len(docs.columns) + 1) if f"{n}_{'_' * k}" not in docs.columns) for n in names]
    kept = materialise(found.select(*[c.alias(n) for c, n in zip(flat(F.col("key")), own, strict=True)]).distinct(), "kept-rows")
    keyed = docs.withColumns(dict(zip(own, flat(key), strict=True)))
    rows = keyed.join(kept.hint("shuffle_hash"), own, "left_semi")
    first = F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64(*docs.columns)))
    return rows.select(*docs.columns, first.alias("_first_of_its_key")).filter("_first_of_its_key = 1").select(*docs.columns)
