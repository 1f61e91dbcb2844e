"""Helpers shared by the corpus operators: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: 0x20 and 0x09 to 0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Where none is set, a local session (tests) takes a temporary folder; a cluster, whose
    executors could not read that, is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="oxbow-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that later steps do not recompute it and a lost executor
    costs only a read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slabs(text: bytes, size: int = 4_000_000) -> Iterator[bytes]:
    """A text in order, in pieces that begin and end at blanks, of about `size` bytes (more only where a run has no blank)."""
    at = 0
    while len(text) - at > size:
        blank = _BLANK.search(text, at + size)
        if blank is None:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def learning_share(column: str, modulus: int, held_out: int) -> F.Column:
    """True for held-out rows: crc32(column as text) mod `modulus` equals `held_out`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == held_out


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Component of every node that has a link: DataFrame (node, root), root being the component's smallest node.

    Alternates large-star and small-star contraction. Every round is two aggregations and two equi-joins on the shrinking edge
    list, written to the checkpoint folder; nothing but two totals reaches the driver. Self-links are dropped, repeated links
    collapse; an empty edge list gives an empty result.
    """
    work = cut(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        total = work.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if total["n"] == 0 or (total["n"], total["h"]) == before:
            return work.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = (total["n"], total["h"])
        both = work.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = cut(large.where("u <> v"))
        # Every edge now points down (v < u), so the smallest lower neighbour is the hub of the small star.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        work = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
