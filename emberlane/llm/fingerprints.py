"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame operations only.

A sketch has three thirds of cells; each paragraph digest goes to one cell of each third. A cell keeps how many digests it
holds and the exclusive-or of the digests and of their check values. Subtracting the sketches of two versions cancels what
both hold. A cell left with one digest (its check value tells) gives that digest away; taking the digest out of its other
cells lays open more (peeling). What does not peel is tried again in a sketch four times as large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.llm.common import keyed_text
from emberlane.session import materialise

CELLS = 12
GROWTH = 4
ROUNDS = 4


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: its lines that are not blank."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))


def _cell(key: Column, third: int, cells: int, level: int) -> Column:
    size = cells // 3
    return (F.pmod(F.xxhash64(key, F.lit(16 * level + third)), F.lit(size)) + third * size).cast("int")


def _check(key: Column, level: int) -> Column:
    return F.xxhash64(key, F.lit(16 * level + 8))


def sketch(keys: DataFrame, by: list[str], cells: int, level: int) -> DataFrame:
    """Cells (by..., cell, n, key, check) of the digests in ``keys`` (by..., sign, key); a sign of -1 subtracts.

    ``keys`` is partitioned by one of ``by`` already, so nothing is shuffled here.
    """
    places = F.explode(F.array(*[_cell(F.col("key"), t, cells, level) for t in range(3)])).alias("cell")
    spread = keys.select(*by, "sign", "key", _check(F.col("key"), level).alias("check"), places)
    return spread.groupBy(*by, "cell").agg(
        F.sum("sign").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")
    )


def subtract(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sum signed cells that stand at one place; cells that cancel out are gone."""
    summed = cells.groupBy(*by, "cell", "found").agg(
        F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")
    )
    return summed.filter((F.col("cell") < 0) | (F.col("n") != 0) | (F.col("key") != 0) | (F.col("check") != 0))


def peel(cells: DataFrame, by: list[str], size: int, level: int, rounds: int = ROUNDS) -> DataFrame:
    """Rows of recovered digests (cell -1, found, n = 1 or -1) and whatever cells are left.

    A step looks for pure cells in one third only, where a digest has one cell, so none is taken out twice.
    """
    for step in range(3 * rounds):
        third = step % 3
        key, n = F.col("key"), F.col("n")
        pure = (
            (F.col("cell") >= 0)
            & (F.abs(n) == 1)
            & (F.col("check") == _check(key, level))
            & (F.col("cell") == _cell(key, third, size, level))
        )

        def row(cell: Column, found: Column, n: Column, key: Column, check: Column) -> Column:
            return F.struct(cell.alias("cell"), found.alias("found"), n.alias("n"), key.alias("key"), check.alias("check"))

        zero = F.lit(0).cast("bigint")
        taken = [row(_cell(key, t, size, level), zero, -n, key, F.col("check")) for t in range(3) if t != third]
        taken.append(row(F.lit(-1), key, n, zero, zero))
        same = row(F.col("cell"), F.col("found"), n, key, F.col("check"))
        moved = cells.select(*by, F.explode(F.when(pure, F.array(*taken)).otherwise(F.array(same))).alias("r"))
        cells = subtract(moved.select(*by, "r.*"), by)
    return cells


def _outcome(cells: DataFrame, by: list[str]) -> DataFrame:
    left = F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") > 0), F.col("found")))
    right = F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") < 0), F.col("found")))
    return cells.groupBy(*by).agg(
        left.alias("only_left"), right.alias("only_right"), F.count(F.when(F.col("cell") >= 0, 1)).alias("stuck")
    )


def _signed(pairs: DataFrame, by: list[str]) -> DataFrame:
    sides = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("left").alias("keys")), F.struct(F.lit(-1).alias("sign"), F.col("right").alias("keys"))
    )
    return pairs.select(*by, F.explode(sides).alias("side")).select(*by, "side.sign", F.explode("side.keys").alias("key"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def differences(pairs: DataFrame, first: DataFrame | None, by: list[str], cells: int = CELLS) -> list[DataFrame]:
    """Written tables (by..., only_left, only_right): the digests that only one side of each pair holds.

    ``pairs`` has by..., left, right (arrays of distinct digests); ``first`` may give the subtracted cells of the smallest
    sketch. Pairs that do not peel are tried with ``GROWTH`` times as many cells and other places, until all are done. Pairs
    without any difference are in no table.
    """
    tables: list[DataFrame] = []
    level = 0
    while True:
        if first is None:
            signed = _signed(pairs.repartition(_parts(pairs), by[0]), by)
            first = subtract(sketch(signed, by, cells, level).withColumn("found", F.lit(0).cast("bigint")), by)
        outcome = materialise(_outcome(peel(first, by, cells, level), by), f"peeled-{level}")
        tables.append(outcome.filter("stuck = 0").drop("stuck"))
        stuck = outcome.filter("stuck > 0").select(*by)
        if stuck.isEmpty():
            return tables
        # Both tables are read again at each level, the pairs only as digests.
        pairs = materialise(pairs.join(stuck, by, "left_semi"), f"stuck-{level}")
        first, cells, level = None, cells * GROWTH, level + 1


# Neighbours in the order of ids --------------------------------------------------------------------------------------


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie at or below ``value``, by binary search; of ``value`` 0 where there are none."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    held = F.array(*[F.lit(c).cast("bigint") for c in cuts])

    def step(found: Column, by: Column) -> Column:
        tried = found + by
        inside = F.get(held, F.least(tried, F.lit(len(cuts))) - 1) <= value
        return F.when((tried <= len(cuts)) & inside, tried).otherwise(found)

    return F.reduce(F.array(*[F.lit(k) for k in steps]), F.lit(0), step)


def id_blocks(rows: DataFrame, blocks: int) -> Column:
    """A number for each row of (id, text): blocks of about equally many rows, in the order of descending ids, nulls last by text.

    The cuts are approximate quantiles of the ids and, for rows without one, of the first seven bytes of their texts, so neither the
    spread of the ids nor a missing one gathers rows. Rows that repeat one id, or lack it and begin alike, share a block.
    """
    beginning = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    shares = [k / blocks for k in range(1, blocks)] or [0.5]
    cut = lambda value: F.percentile_approx(value, shares, max(10_000, 10 * blocks))
    found = rows.agg(cut(F.col("id").cast("bigint")).alias("ids"), cut(F.when(F.col("id").isNull(), beginning)).alias("texts")).first()
    ids, texts = (sorted(set(found[name] or [])) for name in ("ids", "texts"))
    below = blocks + 1 + _bucket(beginning, texts)
    return F.when(F.col("id").isNull(), below).otherwise(blocks - _bucket(F.col("id").cast("bigint"), ids)).cast("bigint")


def with_next_text(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """``rows`` (id, text) with ``next_text``: the text of the next row by descending id, of the first one for the last row.

    Texts are shuffled once, in blocks of neighbouring ids, sixteen for each shuffle partition (so that partitions even out) unless ``blocks`` says how many; only a
    block's first and last row travel once more. Equal ids are ordered by text, null ids come last.
    """
    blocks = blocks or 16 * _parts(rows)
    blocked = rows.withColumn("block", id_blocks(rows, blocks))
    falling = Window.partitionBy("block").orderBy(F.desc_nulls_last("id"), "text")
    rising = Window.partitionBy("block").orderBy(F.asc_nulls_first("id"), F.desc("text"))
    inside = blocked.withColumn("next_text", F.lead("text").over(falling)).filter(F.col("next_text").isNotNull())
    heads = blocked.withColumn("nth", F.row_number().over(falling)).filter("nth = 1")
    tails = blocked.withColumn("nth", F.row_number().over(rising)).filter("nth = 1")

    # Twice as many rows as ``blocks`` at most, in one window.
    there = materialise(blocked.select("block").distinct(), "id-blocks")
    whole = Window.orderBy("block")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = there.select("block", F.coalesce(F.lead("block").over(whole), F.first("block").over(every)).alias("next_block"))
    first_texts = heads.select(F.col("block").alias("next_block"), F.col("text").alias("next_text"))
    across = tails.join(following, "block").join(first_texts, "next_block")
    columns = ["id", "text", "next_text"]
    return inside.select(*columns).unionByName(across.select(*columns))


def _likeness(n_left: Column, n_right: Column, differing: Column) -> Column:
    """Shared share of all distinct paragraphs; 1 where neither side has any."""
    together = n_left + n_right + differing
    return F.when(together == 0, 1.0).otherwise((n_left + n_right - differing) / together)


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the digests
    removed_digests and added_digests that tell the edited text from the row's own.

    The edited text has its last half (rounded down, code points) replaced by as many of the first code points of the next
    row's text, by descending integer id. Fingerprints are the smallest sketches, cell for cell, so equal texts have
    equal ones; likenesses are the share of common paragraphs, from what subtracting and peeling recovers.

    Null text counts as empty; its fingerprint is empty and an empty neighbour is like it (1). Rows with equal ids are
    ordered by text, null ids come last; a single row is its own next. An empty table gives no rows. Other columns are not read.
    """
    rows = with_next_text(keyed_text(docs, id_col, text_col))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    versions = rows.select("id", "text", "next_text", n.cast("bigint").alias("n_chars"), edited.alias("edited")).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited")).alias("new"),
        paragraph_digests(F.col("next_text")).alias("next"),
    )
    # From here on texts are not needed; written once, as row numbers must not change.
    versions = materialise(versions, "paragraph-digests")
    names = ["own", "new", "next"]
    dealt = versions.repartition(_parts(versions), "row")
    keyed = dealt.select("row", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("keys")) for v in names])).alias("x"))
    keys = keyed.select("row", "x.version", F.lit(1).alias("sign"), F.explode("x.keys").alias("key"))
    sketches = materialise(sketch(keys, ["row", "version"], CELLS, 0), "sketches")

    listed = F.array_sort(F.collect_list(F.struct("cell", "n", "key", "check")))
    written = F.concat_ws(
        ";", F.transform(listed, lambda c: F.concat_ws(":", F.hex(c["cell"]), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"])))
    )
    prints = sketches.filter(F.col("version") != "next").repartition(_parts(versions), "row")
    prints = prints.groupBy("row", "version").agg(written.alias("print"))
    prints = prints.groupBy("row").agg(
        F.max(F.when(F.col("version") == "own", F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("version") == "new", F.col("print"))).alias("edited_fingerprint"),
    )

    by = ["row", "other"]
    into = F.when(F.col("version") == "own", F.array(F.lit("new"), F.lit("next"))).otherwise(F.array("version"))
    signed_n = F.when(F.col("version") == "own", F.col("n")).otherwise(-F.col("n"))
    opposed = sketches.repartition(_parts(versions), "row").select(
        "row", F.explode(into).alias("other"), "cell", F.lit(0).cast("bigint").alias("found"), signed_n.alias("n"), "key", "check"
    )
    pairs = versions.select("row", F.col("own").alias("left"), F.explode(F.array(*[F.struct(F.lit(v).alias("other"), F.col(v).alias("right")) for v in names[1:]])).alias("x"))
    pairs = pairs.select("row", "x.other", "left", "x.right")
    tables = differences(pairs, subtract(opposed, by), by)
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    differing = F.size("only_left") + F.size("only_right")
    found = found.groupBy("row").agg(
        F.max(F.when(F.col("other") == "new", differing)).alias("d_new"),
        F.max(F.when(F.col("other") == "next", differing)).alias("d_next"),
        F.first(F.when(F.col("other") == "new", F.col("only_left")), ignorenulls=True).alias("removed_digests"),
        F.first(F.when(F.col("other") == "new", F.col("only_right")), ignorenulls=True).alias("added_digests"),
    )
    zero = F.lit(0)
    return (
        versions.join(prints, "row", "left")
        .join(found, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited_sha256",
            F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
            F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
            _likeness(F.size("own"), F.size("new"), F.coalesce("d_new", zero)).alias("near_edited"),
            _likeness(F.size("own"), F.size("next"), F.coalesce("d_next", zero)).alias("near_next"),
            F.coalesce("removed_digests", F.array().cast("array<bigint>")).alias("removed_digests"),
            F.coalesce("added_digests", F.array().cast("array<bigint>")).alias("added_digests"),
        )
    )
