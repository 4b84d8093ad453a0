"""The life of every posting through the runs of its board.

Two forms of one state machine. ``history`` has it in closed form: windows over
the sightings of a posting, where a gap that holds a run a week after its first
missing one closes the posting. ``merge_run`` is one step of it: the state before
meets the postings of one run in a full outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.runs import judged_runs

#: a posting closes once it was missing this often, the last time so many seconds after the first
ABSENCES, GRACE = 2, 7 * 86_400
#: columns whose change is told
MATERIAL = ("title", "seniority", "location_raw")


def counted_runs(ledger: DataFrame) -> DataFrame:
    """board_id, run_seq, started_at, n, total, closing_n, closing_at of the
    successful runs that are not held as suspicious; n: their place from 1;
    closing: the first run that closes what went missing in this one."""
    by_board = Window.partitionBy("board_id")
    kept = judged_runs(ledger).filter((F.col("status") == "success") & ~F.col("suspicious"))
    kept = kept.select("board_id", "run_seq", "started_at", F.row_number().over(by_board.orderBy("run_seq")).alias("n"), F.count("*").over(by_board).alias("total"))
    later = by_board.orderBy(F.col("started_at").cast("bigint")).rangeBetween(GRACE, Window.unboundedFollowing)
    return kept.select("*", F.min("n").over(later).alias("closing_n"), F.min("started_at").over(later).alias("closing_at"))


def sightings(snapshots: DataFrame, counted: DataFrame, content: dict[str, Column]) -> DataFrame:
    """board_id, id, n, total, started_at and the content of each posting seen in
    a counted run; of repeated ids the copy loaded last. Blank ids give none."""
    key = F.lower(F.trim("id"))
    rows = snapshots.filter((F.col("run_status") == "success") & (key != "")).select("board_id", "run_seq", key.alias("id"), F.struct("loaded_at", *[c.alias(n) for n, c in content.items()]).alias("copy"))
    one = rows.groupBy("board_id", "run_seq", "id").agg(F.max("copy").alias("copy"))
    return one.join(counted.select("board_id", "run_seq", "n", "total", "started_at"), ["board_id", "run_seq"]).select("board_id", "id", "n", "total", "started_at", *[F.col(f"copy.{n}").alias(n) for n in content])


def history(seen: DataFrame, counted: DataFrame, material: tuple[str, ...] = MATERIAL) -> DataFrame:
    """The sightings with what lies before and behind them: last_n (the sighting
    before), next_n, missing_since, closed (the gap behind it closes the
    posting), closing_n, closing_at, opens ('opened', 'reopened' or null),
    first_seen_at, changes (array of field, old, new; of sightings in neighbouring runs)."""
    gaps = counted.select("board_id", (F.col("n") - 1).alias("n"), F.col("started_at").alias("missing_since"), "closing_n", "closing_at")
    by_key = Window.partitionBy("board_id", "id").orderBy("n")
    s = seen.join(gaps, ["board_id", "n"], "left").select("*", F.lag("n").over(by_key).alias("last_n"), F.lead("n").over(by_key).alias("next_n"), F.lag(F.struct(*material)).over(by_key).alias("was"))
    s = s.withColumn("closed", F.coalesce((F.col("closing_n") >= F.col("n") + ABSENCES) & (F.col("next_n").isNull() | (F.col("closing_n") < F.col("next_n"))), F.lit(False)))
    s = s.withColumn("opens", F.when(F.col("last_n").isNull(), "opened").when(F.lag("closed").over(by_key), "reopened"))
    first = F.last(F.when(F.col("opens").isNotNull(), F.col("started_at")), ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    told = [F.when(~F.col(f"was.{m}").eqNullSafe(F.col(m)), F.struct(F.lit(m).alias("field"), F.col(f"was.{m}").alias("old"), F.col(m).alias("new"))) for m in material]
    changes = F.when(F.col("last_n") == F.col("n") - 1, F.array_compact(F.array(*told)))
    return s.withColumn("first_seen_at", first).withColumn("changes", changes)


def events(rows: DataFrame) -> DataFrame:
    """board_id, id, event (opened, updated, reopened, closed), n, occurred_at."""
    each = lambda event, n, at: F.struct(event.alias("event"), n.cast("int").alias("n"), at.alias("occurred_at"))
    begun = F.when(F.col("opens").isNotNull(), each(F.col("opens"), F.col("n"), F.col("started_at"))).when(F.size("changes") > 0, each(F.lit("updated"), F.col("n"), F.col("started_at")))
    ended = F.when(F.col("closed"), each(F.lit("closed"), F.col("closing_n"), F.col("closing_at")))
    return rows.select("board_id", "id", F.inline(F.array_compact(F.array(begun, ended))))


def material_changes(rows: DataFrame) -> DataFrame:
    """board_id, id, n, field, old, new of each change between neighbouring runs."""
    return rows.select("board_id", "id", "n", F.inline("changes"))


def state(rows: DataFrame, content: tuple[str, ...] = MATERIAL) -> DataFrame:
    """The last state of each posting: board_id, id, status, consecutive_absences,
    missing_since, closed_at, first_seen_at, last_seen_at and the content."""
    status = F.when(F.col("closed"), "closed").when(F.col("n") == F.col("total"), "open").otherwise("missing")
    absences = F.when(F.col("closed"), F.col("closing_n") - F.col("n")).otherwise(F.col("total") - F.col("n")).cast("int")
    return rows.filter(F.col("next_n").isNull()).select(
        "board_id", "id", status.alias("status"), absences.alias("consecutive_absences"), F.when(absences > 0, F.col("missing_since")).alias("missing_since"), F.when(F.col("closed"), F.col("closing_at")).alias("closed_at"),
        "first_seen_at", F.col("started_at").alias("last_seen_at"), *content,
    )


def merge_run(before: DataFrame, observed: DataFrame, runs: DataFrame, content: tuple[str, ...] = MATERIAL) -> DataFrame:
    """The state after one run of each board, and what happened: the columns of
    ``state``, event (null for none) and changes.

    before: the state; observed: board_id, id and content; runs: board_id,
    observed_at, held. A held run and a board without a run leave the state
    as it is. An open posting that differs is updated; one that was missing
    comes back silently; a closed one is reopened and begins anew. Of ids
    observed twice, any one counts; null ids match nothing.
    """
    new = observed.filter(F.col("id").isNotNull()).groupBy("board_id", "id").agg(F.max(F.struct(*content)).alias("new"))
    old = before.select("board_id", "id", F.struct(*[c for c in before.columns if c not in ("board_id", "id")]).alias("old"))
    met = old.join(new, ["board_id", "id"], "full_outer").join(runs, "board_id", "left").filter(F.col("old").isNotNull() | ~F.coalesce("held", F.lit(True)))
    idle = F.coalesce("held", F.lit(True))
    seen, was = F.col("new").isNotNull(), F.col("old.status")
    absences, since = F.col("old.consecutive_absences") + 1, F.coalesce("old.missing_since", "observed_at")
    ends = (absences >= ABSENCES) & (F.col("observed_at").cast("bigint") - since.cast("bigint") >= GRACE)
    told = [F.when(~F.col(f"old.{m}").eqNullSafe(F.col(f"new.{m}")), F.struct(F.lit(m).alias("field"), F.col(f"old.{m}").alias("old"), F.col(f"new.{m}").alias("new"))) for m in content]
    changes = F.when(~idle & seen & (was == "open"), F.array_compact(F.array(*told)))
    case = F.when(idle, "kept").when(was.isNull(), "opened").when(seen & (was == "closed"), "reopened").when(seen & (F.size(changes) > 0), "updated").when(seen, "seen").when(was == "closed", "kept").when(ends, "closed").otherwise("missed")
    met = met.withColumn("case", case).withColumn("changes", changes)
    here, kept = F.col("case").isin("opened", "reopened", "updated", "seen"), F.col("case") == "kept"
    pick = lambda name, present, absent: F.when(kept, F.col(f"old.{name}")).when(here, present).otherwise(absent).alias(name)
    none = F.lit(None)
    return met.select(
        "board_id", "id", pick("status", F.lit("open"), F.when(F.col("case") == "closed", "closed").otherwise("missing")), pick("consecutive_absences", F.lit(0), absences), pick("missing_since", none, since),
        pick("closed_at", none, F.when(F.col("case") == "closed", F.col("observed_at"))), pick("first_seen_at", F.when(F.col("case").isin("opened", "reopened"), F.col("observed_at")).otherwise(F.col("old.first_seen_at")), F.col("old.first_seen_at")),
        pick("last_seen_at", F.col("observed_at"), F.col("old.last_seen_at")), *[pick(c, F.col(f"new.{c}"), F.col(f"old.{c}")) for c in content],
        F.when(F.col("case").isin("opened", "reopened", "updated", "closed"), F.col("case")).alias("event"), "changes",
    )
