"""What changed between full snapshots.

The runs of a board are numbered through its successful runs. Each key's rows
are windowed by that number: a lag over the content hashes shows changes, a gap
before a row is an addition, a gap behind it a removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import display_text, trimmed
from leadloom.operators.timestamps import zoned_micros



def run_neighbours(snapshots: DataFrame) -> DataFrame:
    """The successful runs of each board with their neighbours:
    board_id, run_seq, prev_seq, next_seq (null at the ends)."""
    runs = snapshots.filter(F.col("run_status") == "success").select("board_id", "run_seq").distinct()
    by_board = Window.partitionBy("board_id").orderBy("run_seq")
    return runs.select("board_id", "run_seq", F.lag("run_seq").over(by_board).alias("prev_seq"), F.lead("run_seq").over(by_board).alias("next_seq"))


def observations(snapshots: DataFrame) -> DataFrame:
    """One row per board, successful run and posting id (trimmed, lower case):
    of repeated ids the copy with the latest updated_at instant, of equal
    instants the one loaded last. Columns board_id, run_seq, id, title_hash,
    instant, prev_seq, next_seq; null titles and unreadable instants stay null. Rows without id
    (a run that showed no posting) give none."""
    rows = snapshots.filter((F.col("run_status") == "success") & F.col("id").isNotNull()).select(
        "board_id",
        "run_seq",
        F.lower(trimmed(F.col("id"))).alias("id"),
        F.when(F.col("title").isNotNull(), F.xxhash64(display_text(F.col("title")))).alias("title_hash"),
        zoned_micros(F.col("updated_at")).alias("instant"),
        "loaded_at",
    )
    # the neighbours join comes before the window: rows then move by key once
    joined = rows.filter(F.col("id") != "").join(run_neighbours(snapshots), ["board_id", "run_seq"])
    copies = Window.partitionBy("board_id", "id").orderBy("run_seq", "instant", "loaded_at", "title_hash")
    last = joined.select("*", F.lead("run_seq").over(copies).alias("following_seq")).filter(~F.col("following_seq").eqNullSafe(F.col("run_seq")))
    return last.drop("following_seq", "loaded_at")


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """board_id, run_seq (of the later run), id, change ('added', 'removed', 'changed').

    Runs without success don't count; the first successful run of a board has
    no cases. 'changed': title or updated_at instant differs, nulls on either
    side are no difference. A successful run without postings removes all.
    """
    rows = observations(snapshots)
    by_key = Window.partitionBy("board_id", "id").orderBy("run_seq")

    def before(c: str) -> Column:
        return F.lag(c).over(by_key)

    seen = rows.select(
        "*",
        before("run_seq").alias("seen_before"),
        F.lead("run_seq").over(by_key).alias("seen_next"),
        F.coalesce(before("title_hash") != F.col("title_hash"), F.lit(False)).alias("title_differs"),
        F.coalesce(before("instant") != F.col("instant"), F.lit(False)).alias("instant_differs"),
    )
    here = F.when(
        F.col("prev_seq").isNotNull(),
        F.when(F.col("seen_before").isNull() | (F.col("seen_before") != F.col("prev_seq")), "added").when(F.col("title_differs") | F.col("instant_differs"), "changed"),
    )
    gone = F.when(F.col("next_seq").isNotNull() & (F.col("seen_next").isNull() | (F.col("seen_next") != F.col("next_seq"))), "removed")

    def case(run_seq: str, change: Column) -> Column:
        return F.struct(F.col(run_seq).cast("bigint").alias("run_seq"), F.col("id").alias("id"), change.alias("change"))

    cases = F.array(case("run_seq", here), case("next_seq", gone))
    return seen.select("board_id", F.inline(F.filter(cases, lambda c: c["change"].isNotNull())))
