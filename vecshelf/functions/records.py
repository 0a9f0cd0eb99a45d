"""The typed fields of dump records, each read from the parsed document once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.functions.text import json_field, json_string_array, subjects_text, unwrap_text


def _texts(path: str) -> Callable[[], Column]:
    return lambda: json_string_array("doc", path, "json")


def _each(path: str, inner: str) -> Callable[[], Column]:
    """``inner`` of every entry of an array, NULL where an entry has none."""
    return lambda: F.transform(
        F.try_variant_get("doc", path, "array<variant>"), lambda x: json_field(x, inner)
    )


def _plain(path: str) -> Callable[[], Column]:
    return lambda: json_field("doc", path)


# table -> field -> expression over the columns ``doc`` and ``json``
FIELDS: dict[str, dict[str, Callable[[], Column]]] = {
    "authors": {
        "name": _plain("$.name"),
        "birth_date": _plain("$.birth_date"),
        "death_date": _plain("$.death_date"),
        "bio": lambda: unwrap_text("doc", "bio"),
        "alternate_names": _texts("$.alternate_names"),
    },
    "works": {
        "title": _plain("$.title"),
        "subtitle": _plain("$.subtitle"),
        "first_publish_date": _plain("$.first_publish_date"),
        "description": lambda: unwrap_text("doc", "description"),
        "subjects": _texts("$.subjects"),
        "subjects_text": lambda: subjects_text("doc"),
        "author_keys": _each("$.authors", "$.author.key"),
        "cover_id": lambda: json_field("doc", "$.covers[0]").try_cast("int"),
    },
    "editions": {
        "title": _plain("$.title"),
        "work_key": _plain("$.works[0].key"),
        "author_key": _plain("$.authors[0].key"),
        "publish_date": _plain("$.publish_date"),
        "subjects_text": lambda: subjects_text("doc"),
        "isbn13": _plain("$.isbn_13[0]"),
        "description": lambda: unwrap_text("doc", "description"),
        "languages": _each("$.languages", "$.key"),
        "genres": _texts("$.genres"),
    },
}


def landed_fields(kind: Column, columns: Mapping[str, Sequence[str]]) -> list[Column]:
    """One column for each field that ``columns`` names for any table, filled
    where ``kind`` is a table that it is named for."""
    names = dict.fromkeys(name for fields in FIELDS.values() for name in fields)
    out = []
    for name in names:
        value = None
        for table, fields in FIELDS.items():
            if name in fields and name in columns.get(table, ()):
                here = kind == table
                value = F.when(here, fields[name]()) if value is None else value.when(here, fields[name]())
        if value is not None:
            out.append(value.alias(name))
    return out


def typed(df: DataFrame, table: str, names: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the typed fields of a table, all or those in ``names``: as they
    were landed, or parsed here where a frame has the JSON alone. Columns that are
    there stay."""
    missing = [name for name in names or FIELDS[table] if name not in df.columns]
    if not missing:
        return df
    parsed = df.withColumn("doc", F.try_parse_json("json"))
    return parsed.select(*df.columns, *[FIELDS[table][name]().alias(name) for name in missing])
