"""Column functions over paths, names and search text."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Extensions by category; anything else is "other".
CATEGORIES = {
    "code": ["py", "r", "sh", "cpp", "c"],
    "data_matrix": ["h5ad", "h5", "npy", "npz", "loom"],
    "data_table": ["csv", "tsv", "csv.gz", "tsv.gz", "parquet", "xlsx", "xlsm"],
    "config": ["yaml", "yml", "toml", "json", "ini"],
    "doc": ["md", "txt", "rst"],
    "notebook": ["ipynb"],
    "figure": ["png", "svg", "jpg", "jpeg"],
    "figure_pdf": ["pdf"],
    "model": ["pkl", "pt", "pth", "joblib", "model", "rds", "onnx"],
    "log": ["log", "out", "err"],
    "archive": ["gz", "tgz", "zip", "tar"],
}
# Default tags as (pattern, tag): none, since what a path means is its owner's to say. For example [(r"_archived|legacy", "legacy")].
TAGS: list[tuple[str, str]] = []
COMPOUND_EXTENSIONS = ["csv.gz", "tsv.gz"]


def ascii_fold(text: Column) -> Column:
    """Lower case for A to Z alone; `lower` would fold other letters too."""
    return F.translate(text, UPPER, LOWER)


@F.pandas_udf(T.StringType())
def _nfd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


@F.pandas_udf(T.StringType())
def _simple_key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else simple_key(t))


def simple_key(text: str) -> str:
    """Identity of a path: NFC with each character folded to the one character that case folding gives it, if it is one."""
    folded = []
    for c in unicodedata.normalize("NFC", text):
        fold = c.casefold() if c != "ẞ" else "ß"  # the capital sharp s folds to the small one
        folded.append(fold if len(fold) == 1 else c.lower() if len(c.lower()) == 1 else c)
    return "".join(folded)


def _only_where_needed(text: Column, udf) -> Column:
    """Send only texts with characters beyond ASCII to Python."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.when(odd, udf(F.when(odd, text))), ascii_fold(text))


def nfd_fold(text: Column) -> Column:
    """`ascii_fold` after canonical decomposition, so that composed and decomposed accents match."""
    return ascii_fold(_only_where_needed(text, _nfd))


@lru_cache(maxsize=1)
def _composed() -> dict[str, str]:
    """Characters that canonical decomposition takes apart, with what it leaves of each, folded."""
    every = (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: nfd_token(c) for c in every if unicodedata.normalize("NFD", c) != c}


@lru_cache(maxsize=1)
def _by_parts() -> dict[str, str]:
    found: dict[str, str] = {}
    for char, parts in _composed().items():
        found[parts] = found.get(parts, "") + char
    return found


def _joins(char: str) -> bool:
    """Whether a character may be composed with the one before it: combining marks, and the later letters of a Korean syllable."""
    return unicodedata.combining(char) > 0 or 0x1161 <= ord(char) <= 0x11FF


def _class(chars: str) -> str:
    """A pattern of one of some characters, as ranges."""
    points, ranges = sorted(set(map(ord, chars))), []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def composed_class() -> str:
    return _class("".join(_composed()))


@lru_cache(maxsize=256)
def nfd_pattern(token: str) -> tuple[str, bool]:
    """(pattern, whether it is more than the literal): a folded, decomposed token as it may stand in a text that is neither.

    Each letter with its marks may stand composed, in part or whole; the last one also with further marks. Marks that follow one letter count in their canonical order.
    """
    clusters: list[str] = []
    for char in token:
        if clusters and _joins(char):
            clusters[-1] += char
        else:
            clusters.append(char)
    more, parts = False, []
    for i, cluster in enumerate(clusters):
        forms = [re.escape(cluster)]
        for k in range(1, len(cluster) + 1):
            if chars := _by_parts().get(cluster[:k]):
                forms.append(_class(chars) + re.escape(cluster[k:]))
        if i == len(clusters) - 1 and (chars := "".join(c for p, c in _by_parts().items() if len(p) > len(cluster) and p.startswith(cluster))):
            forms.append(_class(chars))
        if i == 0 and _joins(cluster[0]) and (chars := "".join(c for p, c in _by_parts().items() if len(p) > len(cluster) and p.endswith(cluster))):
            forms.append(_class(chars))
        more = more or len(forms) > 1
        parts.append(forms[0] if len(forms) == 1 else f"(?:{'|'.join(forms)})")
    return "".join(parts), more


def holds(folded: Column, token: str) -> Column:
    """Whether an `ascii_fold`ed text holds a token (see `nfd_token`), composed or decomposed; no decomposition of the text is needed."""
    literal = F.contains(folded, F.lit(token))
    pattern, more = nfd_pattern(token)
    return literal | (folded.rlike(r"[^\x00-\x7F]") & folded.rlike(pattern)) if more else literal


def nfd_token(text: str) -> str:
    """A search token folded as `nfd_fold` folds texts."""
    return unicodedata.normalize("NFD", text).translate(str.maketrans(UPPER, LOWER))


def norm_key(path: Column) -> Column:
    return _only_where_needed(path, _simple_key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Directory of a path; the root's is the empty string."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def ancestors(path: Column) -> Column:
    """Directories above a path, from the top; none for a path without a slash."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def is_under(path: Column, root: str) -> Column:
    """The path itself or anything below it, at a slash; the empty root holds everything."""
    return F.lit(True) if root == "" else (path == root) | path.startswith(root + "/")


def ext_of(path: Column, compound: list[str] = COMPOUND_EXTENSIONS) -> Column:
    """Lower-case extension; compound ones win; dotfiles and names without a dot have none."""
    name = F.lower(basename(path))
    stem = F.ltrim(name, F.lit("."))
    both = "|".join(re.escape(c) for c in compound)
    double = F.regexp_extract(stem, rf"[^/]\.({both})$", 1)
    single = F.regexp_extract(stem, r"[^/]\.([^./]+)$", 1)
    return F.when(double != "", double).otherwise(single)


def category_for(ext: Column, categories: dict[str, list[str]] | None = None) -> Column:
    pairs = [F.lit(v) for c, exts in (categories or CATEGORIES).items() for e in exts for v in (e, c)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(ext, F.lit(""))), F.lit("other"))


def tags_for(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Tags whose pattern is found in the path, case aside, in the rules' order, each once."""
    hits = [F.when(path.rlike(f"(?i){pattern}"), F.lit(tag)) for pattern, tag in rules]
    return F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def glob_to_regex(pattern: str) -> str:
    """An fnmatch pattern (* ? [..] [!..]) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def iso_utc(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of epoch seconds, truncated."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def human_bytes(size: Column, base: int = 1024) -> Column:
    """Size with the largest unit that leaves at least 1, one decimal beyond bytes."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    shown = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units[1:], 1):
        scaled = F.format_string(f"%.1f {unit}", size / float(base**power))
        shown = F.when(size >= base**power, scaled).otherwise(shown)
    return shown


def relative_time(seconds_ago: Column) -> Column:
    """How long ago, in the largest whole unit: just now, 5m ago, 3h ago, 2d ago; later than now counts as now, null is empty."""
    ago = F.greatest(F.floor(seconds_ago), F.lit(0))
    shown = F.lit("just now")
    for size, unit in ((60, "m"), (3_600, "h"), (86_400, "d")):
        shown = F.when(ago >= size, F.concat(F.floor(ago / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(shown)
    return F.when(seconds_ago.isNull(), "").otherwise(shown)


def recency(seconds_ago: Column) -> Column:
    """today below 24 hours, week below 7 days, older beyond and where the time is not known; later than now counts as today."""
    return F.when(seconds_ago < 86_400, "today").when(seconds_ago < 604_800, "week").otherwise("older")


def label_tokens(text: Column) -> Column:
    """Words of 2 to 40 characters that are not numbers, in lower case, each where it is first seen."""
    words = F.filter(F.split(text, " "), lambda w: F.char_length(w).between(2, 40) & ~w.rlike(r"^[0-9.,+-]+$"))
    return F.array_distinct(F.transform(words, lambda w: F.lower(w)))


def embeddable(text: Column) -> Column:
    """JSON text for a script element of a page: <, > and & as escapes, so that nothing in it can end the element."""
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def path_form(root: str, path: Column, form: str) -> Column:
    """A path as absolute, relative, posix or file URI text; an empty path or root gives an empty absolute form."""
    absolute = F.when(path == "", F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)) if root else F.lit("")
    if form in ("rel", "posix"):
        return path
    if form == "abs":
        return absolute
    coded = absolute
    for char, code in (("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F")):
        coded = F.replace(coded, F.lit(char), F.lit(code))
    return F.when(absolute == "", F.lit("")).otherwise(F.concat(F.lit("file://"), coded))
