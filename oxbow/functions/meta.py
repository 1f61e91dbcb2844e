"""Column functions over `meta`, the JSON text of a catalogue row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIGURE_KEYS = ["figure_text", "figure_text_mode", "figure_text_truncated"]


def int_at(meta: Column, key: str) -> Column:
    """A top-level integer; floats, strings and other JSON values are null. A cast alone would round floats."""
    token = F.get_json_object(meta, f"$.{key}")
    quoted = meta.rlike(rf'"{key}"\s*:\s*"')
    return F.when(token.rlike(r"^-?\d+$") & ~quoted, token.try_cast("long"))


def shape(meta: Column) -> tuple[Column, Column]:
    """(n_obs, n_vars): rows and columns of whatever the file holds."""
    rows = F.coalesce(int_at(meta, "n_obs"), int_at(meta, "row_count"), int_at(meta, "num_rows"))
    return rows, F.coalesce(int_at(meta, "n_vars"), int_at(meta, "n_columns"))


def strings_at(meta: Column, key: str) -> Column:
    """A top-level array of strings, or null."""
    return F.from_json(F.get_json_object(meta, f"$.{key}"), "array<string>")


def top_keys(meta: Column) -> Column:
    """Top-level keys in their order; null for what is no object."""
    return F.json_object_keys(meta)


def has_key(meta: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(top_keys(meta), key), F.lit(False))


def without_keys(meta: Column, keys: list[str]) -> Column:
    """The object without some top-level keys; texts that do not mention them are untouched and never reach Python."""
    mentioned = meta.rlike("|".join(f'"{k}"' for k in keys))
    return F.coalesce(_drop(F.when(mentioned, meta), F.lit(json.dumps(keys))), meta)


@F.pandas_udf(T.StringType())
def _drop(metas: pd.Series, keys: pd.Series) -> pd.Series:
    def one(text: str | None, names: str) -> str | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return text
        if not isinstance(value, dict):
            return text
        return json.dumps({k: v for k, v in value.items() if k not in json.loads(names)}, ensure_ascii=False)

    return pd.Series([one(t, k) for t, k in zip(metas, keys)], dtype=object)


def figure_text(meta: Column) -> Column:
    """The rendered labels of a figure as lower-cased text, or null."""
    words = strings_at(meta, "figure_text")
    return F.when(F.contains(meta, F.lit("figure_text")) & words.isNotNull(), F.lower(F.array_join(words, " ")))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Keys sorted, no blanks, other characters kept: one text for equal JSON values. Texts that are not JSON stay."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    return texts.map(one)


@F.pandas_udf(T.StringType())
def flatten_json(texts: pd.Series) -> pd.Series:
    """Keys and leaves of a JSON value, in order, separated by blanks."""

    def walk(value) -> list[str]:
        if isinstance(value, dict):
            return [x for k, v in value.items() for x in (k, *walk(v))]
        if isinstance(value, list):
            return [x for v in value for x in walk(v)]
        return [] if value is None else [str(value)]

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else " ".join(walk(json.loads(text)))
        except ValueError:
            return text

    return texts.map(one)
