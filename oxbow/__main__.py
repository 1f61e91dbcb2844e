"""Command line: build, refresh, query and check a catalogue.

    python -m oxbow build ROOT STORE      walk a tree and publish its catalogue
    python -m oxbow refresh ROOT STORE    the same, opening only files that changed and publishing only what differs
    python -m oxbow query STORE TEXT      files that match a search text (--count, --figure-text, --limit, --sort); looks at the tree
                                          first if that was last done more than --fresh seconds ago (10; negative: never)
    python -m oxbow find STORE            files by exact filters (--path, --category, --ext, --has-obs, --obsm, --broken, --errors)
    python -m oxbow check ROOT STORE      what has drifted; exit code 1 if anything has
    python -m oxbow report STORE          Markdown report
    python -m oxbow links STORE           lineage as Graphviz text
    python -m oxbow export STORE PATH     one JSON entry per line
    python -m oxbow extract ROOT REQUESTS what the readers find in the files that lines {"path": ..} ask for, an answer a line, in order
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .checkpoint import cut
from .operators import lineage, report, search
from .sources import catalogue, extract

# Fixed value: seconds for which an answer may be older than the tree.
FRESH = 10.0


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="oxbow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in (("build", "root store"), ("refresh", "root store"), ("query", "store text"), ("find", "store"), ("check", "root store"), ("report", "store"), ("links", "store"), ("export", "store path_out"), ("extract", "root requests")):
        sub = verbs.add_parser(verb)
        for name in names.split():
            sub.add_argument(name)
        if verb in ("query", "find"):
            sub.add_argument("--count", action="store_true")
            sub.add_argument("--limit", type=int, default=100)
            sub.add_argument("--sort", default="path", choices=sorted(search.SORTS))
        if verb == "query":
            sub.add_argument("--figure-text", action="store_true")
            sub.add_argument("--fresh", type=float, default=FRESH)
        if verb == "find":
            for option in ("path", "category", "ext", "extractor", "has-obs", "obsm"):
                sub.add_argument(f"--{option}")
            sub.add_argument("--broken", action="store_true")
            sub.add_argument("--errors", action="store_true")
    return parser


def refresh(store: catalogue.Store, root: str) -> bool:
    """Look at a tree, opening only files that changed, and publish what differs; whether anything did."""
    prior = store.read() if store.generation() else None
    return store.refresh(cut(catalogue.build(store.spark, root, prior=prior, strict=True)), root=os.path.abspath(root))


def freshen(store: catalogue.Store, seconds: float) -> None:
    """Refresh before a read if the last look is too old. Where the tree cannot be read, the answer comes from the last generation."""
    root = store.entry()["notes"].get("root")
    if root is None or seconds < 0 or store.age_seconds() <= seconds:
        return
    try:
        refresh(store, root)
    except Exception as e:  # noqa: BLE001 - an old answer is better than none, and is said to be old
        print(f"not refreshed: {str(e).splitlines()[0]}", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("oxbow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "extract":
        for row in extract.describe_requests(spark.read.text(args.requests), args.root).toLocalIterator():
            print(json.dumps(row.asDict() | {"meta": row["meta"] and json.loads(row["meta"])}, ensure_ascii=False))
        return 0
    store = catalogue.Store(spark, args.store)
    if args.verb == "build":
        print(store.publish(catalogue.build(spark, args.root), root=os.path.abspath(args.root)))
        return 0
    if args.verb == "refresh":
        refresh(store, args.root)
        print(store.generation())
        return 0
    if args.verb == "query":
        freshen(store, args.fresh)
    rows = store.read()
    if args.verb in ("query", "find"):
        if args.verb == "query":
            found = search.search(rows, args.text, figure_text=args.figure_text)
        else:
            found = search.filter_files(rows, args.path, args.category, args.ext, args.extractor, args.has_obs, args.obsm, args.broken, args.errors)
        if args.count:
            print(found.count())
        else:
            for row in search.page(found, args.sort, args.limit).select("path", "category", "size_bytes").collect():
                print(row.path, row.category, row.size_bytes, sep="\t")
        return 0
    if args.verb == "check":
        changes, _ = store.compare(cut(catalogue.build(spark, args.root, strict=True)))
        found = changes.orderBy(F.col("change").isin("broken", "repaired"), "path").limit(search.PAGE_LIMIT).collect()
        for row in found:
            print(row.change, row.path, sep="\t")
        return int(bool(found))
    if args.verb == "report":
        print(report.render(rows))
    elif args.verb == "links":
        for row in lineage.to_dot(lineage.graph(rows)[0]).toLocalIterator():
            print(row.value)
    else:
        catalogue.write_jsonl(rows, args.path_out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
