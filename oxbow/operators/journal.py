"""An operation journal as an event log: the state of an operation is its latest entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of an operation, those it ends in, and what recovery after a crash makes of those in the middle.
STATES = [
    "planned", "executing", "copied", "verified", "finalized", "source_removed", "committed", "settled", "failed", "reverting", "undone",
]
TERMINAL = ["settled", "failed", "undone"]
RECOVERY = {"planned": "failed", "executing": "failed", "committed": "settled"}
NEXT = {"planned": ["executing", "failed"], "executing": ["committed", "failed"], "committed": ["settled", "failed"]}


def current(log: DataFrame) -> DataFrame:
    """(op_id, state, seq) of each operation's latest entry; (op_id, seq, state) in."""
    return log.groupBy("op_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def recovered_state(state: Column) -> Column:
    out = state
    for before, after in RECOVERY.items():
        out = F.when(state == before, F.lit(after)).otherwise(out)
    return out


def pending(states: DataFrame) -> DataFrame:
    """Operations that have not ended."""
    return states.where(~F.col("state").isin(TERMINAL))


def recover(states: DataFrame) -> DataFrame:
    """`states` with the state that recovery after a crash leaves."""
    return states.withColumn("recovered", recovered_state(F.col("state")))


def illegal(log: DataFrame) -> DataFrame:
    """Entries of the log that their operation's previous state does not allow."""
    before = F.lag("state").over(Window.partitionBy("op_id").orderBy("seq"))
    allowed = F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    steps = log.withColumn("before", before)
    wrong = F.col("before").isin(*NEXT) & ~F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("state"))
    return steps.where(wrong | (F.col("before").isNull() & (F.col("state") != "planned")))
