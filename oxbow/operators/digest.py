"""Digests of catalogue content that leave out times.

Rows are hashed where they are, and digests of hash ranges are combined, so neither a sort of the whole table nor one task with all
rows is needed. Metadata are hashed as JSON values, in one canonical text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.meta import canonical_json

FIELDS = ["path", "size_bytes", "extractor", "meta"]


def row_hash(fields: list[str] = FIELDS) -> Column:
    """SHA-256 over the fields; null and empty differ, and no value can run into the next."""
    parts = [F.when(F.col(f).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(F.col(f).cast("string")), F.lit(":"), F.col(f).cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def row_digest(rows: DataFrame, fields: list[str] = FIELDS, prefix: int = 4) -> DataFrame:
    """One row (n_rows, digest): row hashes sorted within groups of a common prefix, then the groups' digests in order."""
    if "meta" in fields:
        rows = rows.withColumn("meta", canonical_json(F.coalesce("meta", F.lit("{}"))))
    hashed = rows.select(row_hash(fields).alias("h")).withColumn("p", F.substring("h", 1, prefix))
    ordered = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    groups = hashed.groupBy("p").agg(F.sha2(ordered("h"), 256).alias("g"), F.count(F.lit(1)).alias("n"))
    top = groups.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "g"))).alias("gs"))
    digest = F.sha2(F.array_join(F.transform("gs", lambda g: g["g"]), ""), 256)
    return top.select(F.coalesce("n", F.lit(0)).alias("n_rows"), digest.alias("digest"))


# A second digest, as a sum of row hashes: sums of parts add up to the sum of the whole, however it is cut.
LANES, LANE_BITS = 8, 32


def _canonical(rows: DataFrame) -> Column:
    """Metadata in canonical form. Texts that are plain objects of no key, as most are, stay out of Python."""
    meta = F.coalesce("meta", F.lit("{}"))
    return F.when(meta == "{}", meta).otherwise(canonical_json(meta))


def lane_sums(rows: DataFrame, by: list[str], digests: dict[str, tuple[list[str], Column]], *others: Column) -> DataFrame:
    """One row a group: for each digest (fields, which rows count) an array of LANES sums modulo 2^32 of row hashes, and other aggregates."""
    if any("meta" in fields for fields, _ in digests.values()):
        rows = rows.withColumn("meta", _canonical(rows))
    hashed = rows.select(*rows.columns, *(F.when(counts, row_hash(fields)).alias(f"__{name}") for name, (fields, counts) in digests.items()))
    lane = lambda name, k: F.conv(F.substring(f"__{name}", 1 + 8 * k, 8), 16, 10).cast("long")
    sums = lambda name: F.array(*(F.pmod(F.coalesce(F.sum(lane(name, k)), F.lit(0)), F.lit(1 << LANE_BITS)) for k in range(LANES)))
    return hashed.groupBy(*by).agg(*others, *(sums(name).alias(name) for name in digests))


def add(parts: Iterable[list[int]]) -> list[int]:
    """Sum of digests, lane by lane; zero for none."""
    total = [0] * LANES
    for part in parts:
        total = [(a + b) % (1 << LANE_BITS) for a, b in zip(total, part)]
    return total


def root_digest(n_rows: int, lanes: list[int]) -> str:
    return f"{n_rows:x}-" + "".join(f"{v:08x}" for v in lanes)


def range_digest(rows: DataFrame, fields: list[str] = FIELDS, prefix: int = 2) -> DataFrame:
    """(part, n_rows, digest) of ranges of rows by the first characters of their path, and of all of them as part ''."""
    part = F.substring("path", 1, prefix)
    sums = lane_sums(rows.withColumn("part", part), ["part"], {"lanes": (fields, F.lit(True))}, F.count(F.lit(1)).alias("n_rows"))
    whole = [F.pmod(F.coalesce(F.sum(F.col("lanes")[k]), F.lit(0)), F.lit(1 << LANE_BITS)).alias(f"l{k}") for k in range(LANES)]
    top = sums.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *whole)
    root = top.select(F.lit("").alias("part"), "n_rows", F.array(*(f"l{k}" for k in range(LANES))).alias("lanes"))
    text = F.array_join(F.transform("lanes", lambda v: F.lpad(F.lower(F.hex(v)), LANES, "0")), "")
    return root.unionByName(sums.select("part", "n_rows", "lanes")).select("part", "n_rows", F.concat(F.lower(F.hex("n_rows")), F.lit("-"), text).alias("digest"))
