"""Exact order statistics, first-N cuts and row positions without sorting a whole dataset in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.labels import hash_order
from evenkeel.operators.joining import attach_settled
from evenkeel.workspace import measure, settle, within_bounds

# A range of keys is ranked by one task only once it holds at most this many rows.
CELL_ROWS = 100_000
# Every narrowing step splits a group's key range into this many cells.
CELLS = 4096
BOUNDS = ["_lo", "_hi", "_tie_lo", "_tie_hi"]


def cut_points(
    rows: DataFrame,
    by: Sequence[str],
    key: Column,
    tie: Column,
    quota: DataFrame | Column,
    cell_rows: int = CELL_ROWS,
    domain: tuple[int, int] | None = None,
) -> DataFrame:
    """The k-th smallest (key, tie) of each group, exactly, as a settled table (by.., cut_key, cut_tie, need, have).

    ``have`` rows lie at the cut and ``need`` of them belong to the first k; both are null where the cut takes every row.

    ``quota`` is k: an expression over the group's row count ``n``, or a table (by.., k). Groups with k <= 0
    have no row in the result; for k >= n the cut takes every row. ``key`` is a long; ``domain`` tells the range
    of evenly spread keys and saves a scan.

    Only narrow columns are read. Group sizes come from one aggregation. As long as the range that holds the
    k-th key is too large for one task, it is split into equal cells, the cells are counted with map-side
    combining, and the search goes on inside one cell per group. A group of any size costs a few scans of two
    columns and no shuffle of its rows.
    """
    by = list(by)
    narrow = rows.select(*by, key.cast("long").alias("_key"), tie.cast("long").alias("_tie"))
    state = settle(_whole_groups(narrow, by, quota) if domain is None else _first_cells(narrow, by, quota, domain))
    nothing = F.lit(None).cast("long")
    whole = state.where("_whole").select(
        *by, F.col("_hi").alias("cut_key"), nothing.alias("cut_tie"), nothing.alias("need"), nothing.alias("have")
    )
    searched = state.where(~F.col("_whole")).drop("_whole")
    # Rows of one key are told apart by the tie, so a crowd of equal keys is narrowed down as well.
    can_narrow = (F.col("_hi") > F.col("_lo")) | (F.col("_tie_hi") > F.col("_tie_lo"))
    too_wide = (F.col("n") > cell_rows) & can_narrow
    # Every later table has at most one narrow row per group, too, so this measurement holds for all of them.
    groups, size, n_wide = measure(state, F.count(F.when(too_wide & ~F.col("_whole"), 1)))
    fits = within_bounds(groups, size)
    while n_wide:
        narrowed = _narrow(narrow, searched.where(too_wide), by, fits)
        searched = settle(searched.where(~too_wide).select(*narrowed.columns).unionByName(narrowed))
        n_wide = searched.where(too_wide).count()
    # A cell of one key and tie needs no ranking, however many rows it holds.
    at_one = searched.where(~can_narrow).select(
        *by, F.col("_lo").alias("cut_key"), F.col("_tie_lo").alias("cut_tie"), F.col("k").alias("need"), F.col("n").alias("have")
    )
    group = Window.partitionBy(*by)
    found = (
        attach_settled(narrow, searched.where(can_narrow).drop("n"), by, fits=fits)
        .where(_inside())
        .groupBy(*by, "_key", "_tie", "k")
        .agg(F.count(F.lit(1)).alias("have"))
        .withColumn("_upto", F.sum("have").over(group.orderBy("_key", "_tie")))
        .withColumn("need", F.col("k") - F.col("_upto") + F.col("have"))
        .where((F.col("need") > 0) & (F.col("k") <= F.col("_upto")))
        .select(*by, F.col("_key").alias("cut_key"), F.col("_tie").alias("cut_tie"), "need", "have")
    )
    return settle(found.unionByName(at_one).unionByName(whole), "cuts")


def _with_quota(sizes: DataFrame, by: list[str], quota: DataFrame | Column) -> DataFrame:
    if isinstance(quota, Column):
        out = sizes.withColumn("k", quota.cast("long"))
    else:
        out = sizes.join(quota.select(*by, F.col("k").cast("long").alias("k")), by)
    return out.where(F.col("k") > 0)


def _whole_groups(narrow: DataFrame, by: list[str], quota: DataFrame | Column) -> DataFrame:
    """The search starts with each group's own key range."""
    stats = narrow.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_key").alias("_lo"),
        F.max("_key").alias("_hi"),
        F.min("_tie").alias("_tie_lo"),
        F.max("_tie").alias("_tie_hi"),
    )
    return _with_quota(stats, by, quota).withColumn("_whole", F.col("k") >= F.col("n"))


def _first_cells(
    narrow: DataFrame, by: list[str], quota: DataFrame | Column, domain: tuple[int, int]
) -> DataFrame:
    """The search starts inside a cell of the domain: sizes and cells are counted in one scan."""
    low, high = domain
    width = (high - low) // CELLS + 1
    cells = narrow.groupBy(*by, _div(F.col("_key") - low, F.lit(width)).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_in_cell"), F.min("_tie").alias("_tie_lo"), F.max("_tie").alias("_tie_hi")
    )
    group = Window.partitionBy(*by)
    upto = F.sum("_in_cell").over(group.orderBy("_cell"))
    sized = cells.select("*", F.sum("_in_cell").over(group).alias("n"), upto.alias("_upto"))
    placed = _with_quota(sized, by, quota).withColumn("_whole", F.col("k") >= F.col("n"))
    wanted = F.least("k", "n")
    start = F.col("_cell") * width + low
    return placed.where(
        (F.col("_upto") - F.col("_in_cell") < wanted) & (wanted <= F.col("_upto"))
    ).select(
        *by,
        F.col("_in_cell").alias("n"),
        start.alias("_lo"),
        (start + (width - 1)).alias("_hi"),
        "_tie_lo",
        "_tie_hi",
        (F.col("k") - F.col("_upto") + F.col("_in_cell")).alias("k"),
        "_whole",
    )


def _inside() -> Column:
    return F.col("_key").between(F.col("_lo"), F.col("_hi")) & F.col("_tie").between(
        F.col("_tie_lo"), F.col("_tie_hi")
    )


def _div(number: Column, by: Column) -> Column:
    """Whole division of longs; going through doubles would lose digits."""
    return F.call_function("div", number, by)


def _narrow(narrow: DataFrame, wide: DataFrame, by: list[str], fits: bool) -> DataFrame:
    """Count the cells of each group's range and keep the one cell that holds the k-th row."""
    on_key = F.col("_hi") > F.col("_lo")
    low = F.when(on_key, F.col("_lo")).otherwise(F.col("_tie_lo"))
    high = F.when(on_key, F.col("_hi")).otherwise(F.col("_tie_hi"))
    width = _div(high - low, F.lit(CELLS)) + 1
    ranges = wide.select(*by, *BOUNDS, "k", on_key.alias("_on_key"), low.alias("_start"), width.alias("_width"))
    value = F.when(F.col("_on_key"), F.col("_key")).otherwise(F.col("_tie"))
    cell = _div(value - F.col("_start"), F.col("_width"))
    counted = (
        attach_settled(narrow, ranges.drop("k"), by, fits=fits)
        .where(_inside())
        .groupBy(*by, cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("_cell"))
    before = F.col("_upto") - F.col("n")
    start = F.col("_start") + F.col("_cell") * F.col("_width")
    end = start + F.col("_width") - 1
    return (
        counted.withColumn("_upto", upto)
        .join(ranges, by)
        .where((before < F.col("k")) & (F.col("k") <= F.col("_upto")))
        .select(
            *by,
            "n",
            F.when(F.col("_on_key"), start).otherwise(F.col("_lo")).alias("_lo"),
            F.when(F.col("_on_key"), F.least(end, "_hi")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(F.col("_on_key"), F.col("_tie_lo")).otherwise(start).alias("_tie_lo"),
            F.when(F.col("_on_key"), F.col("_tie_hi")).otherwise(F.least(end, "_tie_hi")).alias("_tie_hi"),
            (F.col("k") - before).alias("k"),
        )
    )


def up_to_cut(key: Column, tie: Column) -> Column:
    """True for the rows at or before the cut; false where a group has no cut."""
    key, tie = key.cast("long"), tie.cast("long")
    at_cut = (key == F.col("cut_key")) & (F.col("cut_tie").isNull() | (tie <= F.col("cut_tie")))
    return F.coalesce((key < F.col("cut_key")) | at_cut, F.lit(False))


def exact_cuts(
    rows: DataFrame,
    by: Sequence[str],
    key: Column,
    tie: Column,
    quota: DataFrame | Column,
    cell_rows: int = CELL_ROWS,
    domain: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame, Column]:
    """The rows, their groups' settled cuts, and the condition for exactly the first k, once the cuts are attached.

    Where rows at a cut are equal in key and tie and only some of them belong to the first k, all rows are settled with
    a number of their own, and the same search goes on by it among the rows at the cut.
    """
    by = list(by)
    cuts = cut_points(rows, by, key, tie, quota, cell_rows, domain)
    crowded = cuts.where("have > need")
    if crowded.isEmpty():
        return rows, cuts, up_to_cut(key, tie)
    numbered = settle(rows.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    at_cut = (key.cast("long") == F.col("cut_key")) & (tie.cast("long") == F.col("cut_tie"))
    crowd = attach_settled(numbered, settle(crowded, "crowded"), by).where(at_cut).select(*by, "_id")
    quota = crowded.select(*by, F.col("need").alias("k"))
    last = cut_points(crowd, by, F.col("_id"), F.col("_id"), quota, cell_rows).select(*by, F.col("cut_key").alias("cut_id"))
    cuts = settle(cuts.join(last, by, "left"), "cuts")
    among = ~at_cut | F.col("cut_tie").isNull() | F.col("cut_id").isNull() | (F.col("_id") <= F.col("cut_id"))
    return numbered, cuts, up_to_cut(key, tie) & F.coalesce(among, F.lit(True))


def mark_first(
    rows: DataFrame,
    by: Sequence[str],
    key: Column,
    tie: Column,
    quota: DataFrame | Column,
    flag: str = "is_first",
    cell_rows: int = CELL_ROWS,
    domain: tuple[int, int] | None = None,
) -> DataFrame:
    """Flag exactly the first k rows of each group in the order (key, tie). The rows themselves are not shuffled."""
    columns = rows.columns
    rows, cuts, first = exact_cuts(rows, by, key, tie, quota, cell_rows, domain)
    return attach_settled(rows, cuts, by, "left").select(*columns, first.alias(flag))


def first_n(
    rows: DataFrame,
    by: Sequence[str],
    key: Column,
    tie: Column,
    quota: DataFrame | Column,
    cell_rows: int = CELL_ROWS,
    domain: tuple[int, int] | None = None,
) -> DataFrame:
    """Exactly the first k rows of each group in the order (key, tie)."""
    return mark_first(rows, by, key, tie, quota, "_first", cell_rows, domain).where("_first").drop("_first")


def row_positions(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position of every row inside its group.

    Spark's range sort splits even a single huge group over many files, and Parquet knows each row's place in
    its file. Adding up the rows of the files before it gives the position; the only window runs over one row
    per file and group.
    """
    return file_positions(settle(rows.orderBy(*by, *order), "sorted"), by, name)


def file_positions(settled: DataFrame, by: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position of every row inside its group, in the order in which a sorted table was settled."""
    by = list(by)
    placed = settled.select(
        *settled.columns,
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    per_file = placed.groupBy(*by, "_file").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_from")
    )
    part_no = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")
    earlier = Window.partitionBy(*by).orderBy(part_no, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(
        *by, "_file", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift")
    )
    joined = attach_settled(placed, settle(offsets, "offsets"), [*by, "_file"])
    return joined.select(*settled.columns, (F.col("_row") + F.col("_shift")).alias(name))


def first_match(rows: DataFrame, by: Sequence[str], order: str, condition: Column, value: Column) -> DataFrame:
    """Per group the value of the first row that meets the condition; a group without one is an error."""
    found = rows.groupBy(*by).agg(
        F.min_by(F.when(condition, value), F.when(condition, F.col(order))).alias("found"),
        F.count(F.when(condition, 1)).alias("_hits"),
    )
    checked = F.when(F.col("_hits") == 0, F.raise_error(F.lit("no matching element in a group")))
    return found.select(*by, checked.otherwise(F.col("found")).alias("found"))


def shuffle_rows(rows: DataFrame, seed: int, *ids: str) -> DataFrame:
    """Rows in a seeded order that does not depend on how they were partitioned."""
    return rows.withColumn("_key", hash_order(seed, *[F.col(c) for c in ids])).orderBy("_key", *ids).drop("_key")
