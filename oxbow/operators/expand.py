"""How far a folder may be opened within a number of shown rows.

What each folder holds, itself and below, is counted for all folders at once by naming every path's ancestors. The walk itself opens folders in the order
they are shown, and never shows more than CEILING rows: a folder is opened only if its own rows fit, so all the children that the walk
ever compares are at most that many, whatever the size of the tree. It asks for the children of the folders it may come to, a round of
them at a time; the folders that it opens whole are then told apart by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.text import ancestors, basename, norm_key, parent_of
from .tree import directories

# Fixed value: rows that are never exceeded.
CEILING = 8_000


def folder_counts(catalog: DataFrame) -> DataFrame:
    """(path, parent, own_files, own_dirs, files, dirs) of every folder, the root as the empty path.

    files and dirs count everything below the folder, without itself. The root's parent is null.
    """
    above = lambda path: F.concat(F.array(F.lit("")), ancestors(path))
    rows = catalog.select("path", F.lit(0).alias("dir")).unionByName(directories(catalog).select("path", F.lit(1).alias("dir")))
    named = rows.select(F.explode(above(F.col("path"))).alias("at"), parent_of(F.col("path")).alias("own"), "dir")
    own = F.col("own") == F.col("at")
    counts = named.groupBy("at").agg(
        F.count_if(own & (F.col("dir") == 0)).alias("own_files"), F.count_if(own & (F.col("dir") == 1)).alias("own_dirs"),
        F.count_if(F.col("dir") == 0).alias("files"), F.count_if(F.col("dir") == 1).alias("dirs"),
    )
    parent = F.when(F.col("at") != "", parent_of(F.col("at")))
    return counts.select(F.col("at").alias("path"), parent.alias("parent"), "own_files", "own_dirs", "files", "dirs")


@dataclass
class Plan:
    """Folders opened with a part of what is below them, and folders opened with all of it; rows are what that shows."""

    budget: int
    part: list[str] = field(default_factory=list)
    whole: list[str] = field(default_factory=list)
    rows: int = 0
    files: int = 0
    opened: int = 0
    closed: int = 0
    total_files: int = 0
    beyond_ceiling: bool = False

    @property
    def truncated(self) -> bool:
        return self.closed > 0


def _walk(root, children: dict[str, list], budget: int) -> tuple[Plan, list]:
    """(plan, folders whose children have to be known first): children are rows of `folder_counts` in the order shown."""
    plan = Plan(budget, total_files=root["files"], beyond_ceiling=root["files"] + root["dirs"] > CEILING)
    left, open_ = budget, [root]
    while open_:
        folder = open_.pop()
        cost = folder["own_files"] + folder["own_dirs"]
        if cost > left:
            plan.closed += 1 + folder["dirs"]
            continue
        if folder["own_dirs"] and folder["path"] not in children:
            return plan, [folder, *reversed(open_)]
        plan.part.append(folder["path"])
        plan.files, plan.opened, left = plan.files + folder["own_files"], plan.opened + 1, left - cost
        later = []
        for child in children.get(folder["path"], ()):  # first those that can be opened whole
            below = child["files"] + child["dirs"]
            if below <= left:
                plan.whole.append(child["path"])
                plan.files, plan.opened, left = plan.files + child["files"], plan.opened + 1 + child["dirs"], left - below
            else:
                later.append(child)
        open_ += reversed(later)
    plan.rows = budget - left
    return plan, []


def expand(counts: DataFrame, root: str = "", budget: int = 1_500) -> tuple[Plan, DataFrame]:
    """(plan, (path, own_files, whole) of the folders that are open) for a folder of `folder_counts`, or an empty plan if it is not there.

    First every child whose whole contents fit is opened, in the order of folded names; then, in the same order, the others as far as the rest
    allows. Folders too large for what is left stay closed. A budget is taken between 0 and CEILING.
    """
    budget, counts = max(0, min(int(budget), CEILING)), cut(counts)
    spark, top = counts.sparkSession, counts.where(F.col("path") == root).first()
    plan = Plan(budget)
    if top is not None:
        children: dict[str, list] = {}
        while True:
            plan, needed = _walk(top, children, budget)
            if not needed:
                break
            asked, size = [], 0
            for folder in needed:
                size += folder["own_dirs"]
                if folder["own_files"] + folder["own_dirs"] <= budget and (not asked or size <= 4 * CEILING):
                    asked.append(folder["path"])
            children |= {path: [] for path in asked}
            found = counts.where(F.col("parent").isin(asked)).withColumn("key", norm_key(basename(F.col("path")))).orderBy("parent", "key", "path")
            for row in found.collect():  # at most 4 * CEILING rows
                children[row["parent"]].append(row)
    opened = spark.createDataFrame([(p, False) for p in plan.part] + [(p, True) for p in plan.whole], "mark string, whole boolean")
    at = counts.select("path", "own_files", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.array("path"))).alias("mark"))
    found = at.join(F.broadcast(opened), "mark").where("whole or path = mark")  # at most CEILING marks
    return plan, found.select("path", "own_files", "whole").distinct()
