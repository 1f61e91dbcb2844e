"""A manifest: one JSON document {.., "entries": [{..}, ..]} of a whole catalogue.

The document is read by byte ranges, cut behind closing braces, so one large file is read by many tasks. Whether a range begins inside a string, and how
deep in braces and brackets, follows from what the ranges before it hold: a first pass sums that up for each range, for both cases of a
string, and only these sums pass the driver. A second pass puts entries together; one that lies across ranges is joined from their ends.

It is written as sorted parts, which one stream puts together and a rename puts in place, as one file needs one writer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder

_MARK = re.compile(r'\\.|["{}\[\]]')
_SUMS = "part long, quotes long, braces long, brackets long, braces_in long, brackets_in long"
_PIECES = "part long, kind string, value string"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range adds: quotes, and braces and brackets outside strings if it begins outside one, and if it begins inside one."""
    quotes, braces, brackets = 0, [0, 0], [0, 0]
    for batch in batches:
        for fragment in batch.column(0).to_pylist():
            for mark in _MARK.findall(f"{fragment}}}"):
                if mark == '"':
                    quotes += 1
                elif mark in "{}":
                    braces[quotes % 2] += 1 if mark == "{" else -1
                elif mark in "[]":
                    brackets[quotes % 2] += 1 if mark == "[" else -1
    row = [TaskContext.get().partitionId(), quotes, braces[0], brackets[0], braces[1], brackets[1]]
    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=[c.split()[0] for c in _SUMS.split(", ")])


def _cut(starts: dict[int, tuple[bool, int, int]]):
    """Entries of each range, whole, or as the end (head), the beginning (tail) or all of a range that lies in the middle of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        inside, braces, brackets = starts[part]
        open_ = braces > 1 and brackets > 0  # in the middle of an entry
        begun, held, out = not open_, [], []
        for batch in batches:
            for fragment in batch.column(0).to_pylist():
                text, at = f"{fragment}}}", 0
                for mark in _MARK.finditer(text):
                    sign = mark[0]
                    if sign == '"':
                        inside = not inside
                    elif inside or sign[0] == "\\":
                        continue
                    elif sign == "{":
                        if braces == 1 and brackets == 1:
                            open_, begun, at, held = True, True, mark.start(), []
                        braces += 1
                    elif sign == "}":
                        braces -= 1
                        if open_ and braces == 1:
                            held.append(text[at : mark.end()])
                            out.append((part, "whole" if begun else "head", "".join(held)))
                            open_, begun, held, at = False, True, [], mark.end()
                    else:
                        brackets += 1 if sign == "[" else -1
                if open_:
                    held.append(text[at:])
            if out:
                yield _batch(out)
                out = []
        if open_ and held:
            yield _batch([(part, "tail" if begun else "middle", "".join(held))])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])


def entry_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the JSON text of each entry of a document, in no order. A document that does not close is refused."""
    fragments = spark.read.text(path, lineSep="}")
    sums = {r["part"]: r for r in fragments.mapInArrow(_sums, _SUMS).collect()}  # a row a range
    starts, state = {}, (False, 0, 0)
    for part in sorted(sums):
        starts[part], s = state, sums[part]
        inside, braces, brackets = state
        # Begun inside a string, what seems outside is inside, and the other way round.
        add = (s["braces_in"], s["brackets_in"]) if inside else (s["braces"], s["brackets"])
        state = (inside ^ bool(s["quotes"] % 2), braces + add[0], brackets + add[1])
    if sums and (state[0] or state[2] or state[1] not in (0, -1)):  # a brace is added behind what follows the last one
        raise ValueError(f"{path} is no whole document: strings, braces or brackets stay open")
    pieces = fragments.mapInArrow(_cut(starts), _PIECES)
    ends = pieces.where("kind <> 'whole'")
    marks = ends.select("part", "kind").collect()  # at most two a range
    # A range's head comes before its tail, whatever their names' order.
    group, current = [], None
    for part, kind in sorted(((m["part"], m["kind"]) for m in marks), key=lambda m: (m[0], m[1] == "tail")):
        current = part if kind == "tail" else current
        group.append((part, kind, current))
    whole = pieces.where("kind = 'whole'").select("value")
    if not group:
        return whole
    joined = ends.join(F.broadcast(spark.createDataFrame(group, "part long, kind string, entry long")), ["part", "kind"])
    order = F.array_sort(F.collect_list(F.struct("part", "value")))
    across = joined.groupBy("entry").agg(F.array_join(F.transform(order, lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(across.select("value"))


def write_document(lines: DataFrame, head: dict, path: str) -> None:
    """{**head, "entries": [..]} as one file, from JSON texts (value) in their order. Readers see it whole or not at all."""
    spark = lines.sparkSession
    folder, _, name = path.rpartition("/")
    parts = f"{path}.parts"
    lines.select(F.concat(F.lit(","), "value").alias("value")).write.mode("overwrite").text(parts)
    files = Folder(spark, folder or ".")
    names = [f"{name}.parts/{n}" for n in files.names(f"{name}.parts") if n.startswith("part-")]
    text = json.dumps(head)
    opening = f"{text[:-1]}{', ' if head else ''}\"entries\": [\n "
    files.join(names, name, opening, "]}\n", skip=1)
    files.remove(f"{name}.parts")
