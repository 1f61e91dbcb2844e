"""Structural metadata of files: names and shapes, never values.

Small readers, one per kind of file, run inside Spark tasks over batches of paths (`describe`); a reader's failure becomes that row's
error. `register` adds or replaces a reader for its extensions. Sizes are gated so that no file is read whole just to be counted.
"""

from __future__ import annotations

import ast
import csv
import gzip
import io
import json
import os
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .isolated import LIMIT, Helper
from .workbooks import describe_workbook

# Size gates in bytes.
HEADER, PARSED, COUNTED, COUNTED_GZ, DRAWN = (n << 20 for n in (1, 5, 100, 25, 20))

Reader = Callable[[str], dict]
_READERS: dict[str, tuple[str, Reader]] = {}


def register(name: str, *extensions: str) -> Callable[[Reader], Reader]:
    """Make a function the reader of some extensions; the last one registered serves."""

    def keep(reader: Reader) -> Reader:
        _READERS.update({e: (name, reader) for e in extensions})
        return reader

    return keep


def _text(path: str, most: int) -> str:
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rb") as f:
        return f.read(most).decode("utf-8", "replace")


@register("tabular", "csv", "tsv", "csv.gz", "tsv.gz")
def delimited(path: str) -> dict:
    delimiter = "\t" if ".tsv" in path.lower()[-7:] else ","
    rows = csv.reader(io.StringIO(_text(path, HEADER), newline=""), delimiter=delimiter)
    columns = next(rows, None)
    if columns is None:
        return {"columns": [], "n_columns": 0, "delimiter": delimiter, "row_count_exact": False, "row_count_reason": "empty"}
    found = {"columns": columns, "n_columns": len(columns), "delimiter": delimiter}
    if os.path.getsize(path) > (COUNTED_GZ if path.endswith(".gz") else COUNTED):
        return found | {"row_count_exact": False, "row_count_reason": "size_gated"}
    opener = gzip.open if path.endswith(".gz") else open
    try:
        with opener(path, "rt", encoding="utf-8", errors="replace", newline="") as f:
            count = sum(1 for _ in csv.reader(f, delimiter=delimiter)) - 1
    except (OSError, EOFError, csv.Error):
        return found | {"row_count_exact": False, "row_count_reason": "read_error"}
    return found | {"row_count": count, "row_count_exact": True}


@register("tabular", "parquet")
def parquet(path: str) -> dict:
    from pyarrow import parquet as pq

    with pq.ParquetFile(path) as f:
        columns = [{"name": c.name, "type": str(c.type)} for c in f.schema_arrow]
        return {"columns": columns, "n_columns": len(columns), "num_rows": f.metadata.num_rows, "num_row_groups": f.metadata.num_row_groups}


@register("xlsx", "xlsx", "xlsm")
def workbook(path: str) -> dict:
    return describe_workbook(path)


def _npy_header(data: bytes) -> dict:
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy header")
    wide = data[6] > 1
    size = int.from_bytes(data[8 : 12 if wide else 10], "little")
    header = ast.literal_eval(data[12 if wide else 10 :][:size].decode("latin-1"))
    return {"shape": list(header["shape"]), "dtype": header["descr"], "fortran_order": header["fortran_order"]}


def _h5(path: str, read: Callable) -> dict:
    """What `read` finds in an HDF5 file; nothing where the optional library is missing."""
    try:
        import h5py
    except ImportError:
        return {}
    with h5py.File(path, "r") as f:
        return read(f)


@register("hdf5", "h5", "hdf5")
def hdf5(path: str) -> dict:
    def read(f) -> dict:
        shapes = {}
        for name, item in f.items():
            for path, leaf in [(name, item), *((f"{name}/{k}", v) for k, v in (item.items() if hasattr(item, "items") else ()))]:
                if hasattr(leaf, "shape"):
                    shapes[path] = list(leaf.shape)
        return {"top_level_groups": list(f), "datasets": shapes}

    return _h5(path, read)


@register("h5ad", "h5ad")
def annotated_matrix(path: str) -> dict:
    """Shape, column names and keys of an annotated matrix, from attributes and keys alone."""

    def read(f) -> dict:
        names = lambda key: [c.decode() if isinstance(c, bytes) else str(c) for c in f[key].attrs.get("column-order", [])] if key in f else []
        keys = lambda key: list(f[key]) if key in f else []
        shapes = lambda key: {k: list(v.shape) if hasattr(v, "shape") else None for k, v in f[key].items()} if key in f else {}
        x = f.get("X")
        shape = list(x.shape) if hasattr(x, "shape") else list(x.attrs.get("shape", [])) if x is not None else []
        n_obs, n_vars = (int(v) for v in shape) if len(shape) == 2 else (None, None)
        values = x["data"] if x is not None and not hasattr(x, "shape") and "data" in x else x
        return {
            "n_obs": n_obs, "n_vars": n_vars, "X_encoding": x is not None and str(x.attrs.get("encoding-type", "array")) or None,
            "X_dtype": str(values.dtype) if hasattr(values, "dtype") else None,
            "obs_index": str(f["obs"].attrs.get("_index", "")) if "obs" in f else None, "obs_columns": names("obs"), "var_columns": names("var"),
            "n_var_columns": len(names("var")), "obsm": shapes("obsm"), "varm": shapes("varm"), "layers": keys("layers"), "obsp": keys("obsp"),
            "uns_keys": keys("uns"), "has_raw": "raw" in f,
        }

    return _h5(path, read)


@register("npy", "npy", "npz")
def arrays(path: str) -> dict:
    if not path.endswith(".npz"):
        with open(path, "rb") as f:
            return _npy_header(f.read(HEADER))
    members = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            try:
                with z.open(name) as f:
                    head = _npy_header(f.read(65_536))
                members[name.removesuffix(".npy")] = {k: head[k] for k in ("shape", "dtype")}
            except (ValueError, SyntaxError):
                continue  # a member that is no array
    return {"n_members": len(members), "members": members}


@register("structured", "json", "yaml", "yml", "toml")
def structured(path: str) -> dict:
    if os.path.getsize(path) > PARSED:
        return {"row_count_reason": "size_gated"}
    text = _text(path, PARSED)
    if path.endswith(".json"):
        value = json.loads(text)
    elif path.endswith(".toml"):
        import tomllib

        value = tomllib.loads(text)
    else:
        try:
            import yaml

            value = yaml.safe_load(text)
        except ImportError:
            value = dict.fromkeys(re.findall(r"(?m)^([\w.\-]+)\s*:", text))
    if isinstance(value, dict):
        return {"top_level_keys": list(map(str, value)), "n_keys": len(value)}
    return {"length": len(value)} if isinstance(value, list) else {"json_type": type(value).__name__}


@register("structured", "ipynb")
def notebook(path: str) -> dict:
    book = json.loads(_text(path, DRAWN))
    cells = book.get("cells", [])
    kinds = [c.get("cell_type") for c in cells]
    lines = (line for c in cells if c.get("cell_type") == "markdown" for line in "".join(c.get("source", [])).splitlines())
    title = next((line.lstrip("#").strip() for line in lines if line.startswith("#")), None)
    kernel = book.get("metadata", {}).get("kernelspec", {}).get("name")
    return {"n_cells": len(cells), "n_code": kinds.count("code"), "n_markdown": kinds.count("markdown"), "kernel": kernel, "first_title": title}


def _link_targets(text: str) -> Iterator[str]:
    """Targets of [label](target), images left out: at each "](" some open bracket before it is no image's, and a target follows."""
    done = 0
    while (close := text.find("](", done)) >= 0:
        label = text[max(done, text.rfind("]", done, close) + 1) : close]
        begin = close - len(label)
        done = close + 2
        if any(c == "[" and text[begin + i - 1 : begin + i] != "!" for i, c in enumerate(label)):
            target = text[done : done + 4096].lstrip().removeprefix("<")
            end = next((i for i, c in enumerate(target) if c in ")>" or c.isspace()), len(target))
            if end:
                yield target[:end]


@register("doc", "md")
def markdown(path: str) -> dict:
    text = _text(path, PARSED)
    plain = re.sub(r"(?ms)^(```|~~~).*?^\1[^\n]*$", "", text)
    title = re.search(r"(?m)^#\s+(.+?)\s*$", plain)
    blocks = (" ".join(b.split()) for b in re.split(r"\n\s*\n", plain))
    paragraph = next((b for b in blocks if b and b[0] not in "#>-*|!<="), None)
    links = list(_link_targets(plain))
    spans = [s for s in re.findall(r"`([^`\n]+)`", plain) if re.search(r"[\w\-]\.\w{1,6}$", s) and " " not in s.strip()]
    refs = list(dict.fromkeys(r for r in [*links, *spans] if not r.startswith("#")))
    return {"h1_title": title and title[1], "first_paragraph": paragraph, "n_outbound_path_refs": len(refs), "outbound_refs": refs}


@register("code", "py")
def python_source(path: str) -> dict:
    tree = ast.parse(_text(path, PARSED))
    names = lambda *kinds: [n.name for n in tree.body if isinstance(n, kinds)]
    imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names]
    imports += [("." * n.level) + (n.module or "") for n in tree.body if isinstance(n, ast.ImportFrom)]
    doc = (ast.get_docstring(tree) or "").strip().splitlines()
    return {
        "docstring_first_line": doc[0] if doc else None,
        "defs": names(ast.FunctionDef, ast.AsyncFunctionDef),
        "classes": names(ast.ClassDef),
        "imports": list(dict.fromkeys(imports)),
    }


@register("code", "r", "R")
def r_source(path: str) -> dict:
    text = _text(path, PARSED)
    title = re.search(r"(?m)^#'\s*(?:@title\s+)?(\S.*)$", text)
    return {
        "functions": list(dict.fromkeys(re.findall(r"(?m)^\s*([\w.]+)\s*(?:<-|=)\s*function\b", text))),
        "libraries": list(dict.fromkeys(re.findall(r"\b(?:library|require)\(\s*[\"']?([\w.]+)", text))),
        "roxygen_title": title and title[1],
    }


@register("code", "sh")
def shell_source(path: str) -> dict:
    lines = _text(path, 65_536).splitlines()
    shebang = lines[0] if lines and lines[0].startswith("#!") else None
    comment = next((x.lstrip("# ").rstrip() for x in lines[bool(shebang) :] if x.startswith("#") and x.strip("# ")), None)
    return {"shebang": shebang, "first_comment": comment}


# Characters of a figure's words, and those that numbers alone are made of.
WORD_CHARACTERS = r"A-Za-z0-9_.:+\-"
NUMBER_CHARACTERS = r"\d.:+\-"


@register("figure_text", "svg")
def drawing(path: str) -> dict:
    """Words a figure shows: its text elements, or the comments and titles that name its glyph groups; once each, lower case."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(DRAWN if size <= DRAWN else DRAWN // 4)
        if size > DRAWN:
            f.seek(size - DRAWN * 3 // 4)
            head += b"\n" + f.read()
    text = head.decode("utf-8", "replace")
    shown = [re.sub(r"<[^>]+>", " ", t) for t in re.findall(r"(?s)<(?:text|title)\b[^>]*>(.*?)</(?:text|title)>", text)]
    groups = re.findall(r'(?s)<g id="text_\d+">(.*?)</g>', text)
    glyphs = ["".join(chr(int(h, 16)) for h in re.findall(r'(?:xlink:)?href="#[^"]*-([0-9a-fA-F]{2,6})"', g)) for g in groups]
    words = re.findall(f"[{WORD_CHARACTERS}]+", " ".join([*shown, *glyphs]).lower())
    kept = list(dict.fromkeys(w for w in words if 2 <= len(w) <= 40 and not re.fullmatch(f"[{NUMBER_CHARACTERS}]+", w)))
    mode = "text" if shown else "glyph" if glyphs else "none"
    return {"figure_text": kept, "figure_text_mode": mode} | ({"figure_text_truncated": True} if size > DRAWN else {})


def read_one(root: str, path: str, ext: str) -> tuple[str, str, str | None]:
    """(extractor, meta JSON, error) of one file; any failure of its reader is an error text."""
    name, reader = _READERS.get(ext, ("generic", lambda _: {}))
    try:
        return name, json.dumps(reader(os.path.join(root, path)), ensure_ascii=False), None
    except Exception as e:  # noqa: BLE001 - a broken file must not end the job
        return name, "{}", f"{type(e).__name__}: {e}"


def describe(files: DataFrame, root: str, readers: dict[str, tuple[str, Reader]] | None = None, limit: float = LIMIT) -> DataFrame:
    """`files` (path, ext, is_symlink, error, ..) with extractor, meta and error. Links and rows with an error are not opened.

    Files are read in a child of the task: a reader that gives no answer within `limit` seconds, or ends its process, costs its own file
    an error and no other.
    """
    own = dict(_READERS) | (readers or {})
    columns = [c for c in files.columns if c not in ("extractor", "meta")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        helper = _helper(limit, own)
        try:
            for batch in batches:
                closed = batch["is_symlink"].fillna(False).astype(bool) | batch["error"].notna()
                answers = helper.answers((root, p, x) for p, x, c in zip(batch["path"], batch["ext"], closed) if not c)
                found = [("generic", "{}", e) if c else next(answers) for c, e in zip(closed, batch["error"])]
                batch["extractor"], batch["meta"], batch["error"] = zip(*found) if found else ([], [], [])
                yield batch
        finally:
            helper.close()

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns)
    return files.select(columns).mapInPandas(run, f"{schema}, extractor string, meta string")


def _helper(limit: float, readers: dict[str, tuple[str, Reader]] | None = None) -> Helper:
    """A child that reads; `readers` are those of the driver, which the task's own copy of this module does not know."""
    _READERS.update(readers or {})
    failed = lambda request, reason: (_READERS.get(request[2], ("generic", None))[0], "{}", reason)
    return Helper(read_one, failed, limit)


def numbered(lines: DataFrame) -> DataFrame:
    """`lines` with `line`, their number from 0 in the order of the partitions and within them; only a count a partition passes the driver."""
    place = lines.withColumn("__at", F.monotonically_increasing_id())  # partition, then a count in it
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in place.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offsets = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)) if before else F.create_map().cast("map<bigint,bigint>")
    return place.withColumn("line", F.element_at(offsets, part) + within).drop("__at")


def describe_requests(lines: DataFrame, root: str, limit: float = LIMIT) -> DataFrame:
    """(line, value, path, extractor, meta, error) for request lines {"path": ..}, in their order; blank lines are left out.

    Every other line has one answer: a malformed one, a file that is not there and a reader that gave no answer are errors of their own.
    """

    own = dict(_READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.text import COMPOUND_EXTENSIONS

        helper = _helper(limit, own)
        try:
            for batch in batches:
                paths, errors, asked = [], [], []
                for value in batch["value"]:
                    path = error = None
                    try:
                        path = json.loads(value)["path"]
                        low = path.lower()
                        if not os.path.lexists(os.path.join(root, path)):
                            raise FileNotFoundError(path)
                        ext = next((c for c in COMPOUND_EXTENSIONS if low.endswith("." + c)), low.rsplit(".", 1)[-1] if "." in low else "")
                        asked.append((root, path, ext))
                    except (ValueError, KeyError, TypeError, AttributeError, OSError) as e:
                        path, error = None, f"{type(e).__name__}: {e}"
                    paths.append(path)
                    errors.append(error)
                answers = helper.answers(asked)
                rows = [(None, None, e) if e else next(answers) for e in errors]
                made = pd.DataFrame(rows, columns=["extractor", "meta", "error"])
                yield pd.concat([batch[["line", "value"]].reset_index(drop=True), pd.Series(paths, name="path", dtype=object), made], axis=1)
        finally:
            helper.close()

    asked = numbered(lines).where("trim(value) <> ''").select("line", "value")
    return asked.mapInPandas(run, "line long, value string, path string, extractor string, meta string, error string").orderBy("line")
