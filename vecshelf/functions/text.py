"""Text and JSON expressions used by ingest, curation and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def input_text(author: Column | str, title: Column | str, prefix: str = "Book") -> Column:
    """The embedded string ``prefix|author|title``; NULL if a part is NULL."""
    return F.concat(F.lit(f"{prefix}|"), _col(author), F.lit("|"), _col(title))


def content_key(text: Column | str) -> Column:
    """SHA-256 hex digest of the UTF-8 text."""
    return F.sha2(_col(text), 256)


def strip_prefix(key: Column | str, prefix: str = "/works/") -> Column:
    return F.replace(_col(key), F.lit(prefix), F.lit(""))


def extract_year(text: Column | str) -> Column:
    """First run of four digits as INT, NULL if there is none."""
    return F.regexp_extract(_col(text), r"\d{4}", 0).try_cast("int")


def json_field(variant: Column | str, path: str, as_type: str = "string") -> Column:
    """The value at ``path`` of a parsed document, NULL if absent or of no such type."""
    return F.try_variant_get(_col(variant), path, as_type)


def json_string_array(variant: Column | str, path: str, raw: Column | str | None = None) -> Column:
    """A JSON array as ``array<string>``; NULL when the value is not an array.

    Elements that are no strings keep the text they have in ``raw``, the JSON
    the document was parsed from; without it numbers are written anew.
    """
    plain = F.try_variant_get(_col(variant), path, "array<string>")
    if raw is None:
        return plain
    parts = F.try_variant_get(_col(variant), path, "array<variant>")
    mixed = F.exists(parts, lambda x: F.schema_of_variant(x) != "STRING")
    return F.when(mixed, F.from_json(F.get_json_object(_col(raw), path), "array<string>")).otherwise(plain)


def is_object(variant: Column | str, path: str) -> Column:
    inner = F.try_variant_get(_col(variant), path, "variant")
    return F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))


def unwrap_text(variant: Column | str, field: str) -> Column:
    """Text stored either plain or as ``{"type": ..., "value": text}``."""
    return F.when(
        is_object(variant, f"$.{field}"), json_field(variant, f"$.{field}.value")
    ).otherwise(json_field(variant, f"$.{field}"))


def subjects_text(variant: Column | str) -> Column:
    """The serialized ``subjects`` of a parsed document in lower case."""
    return F.lower(F.to_json(F.try_variant_get(_col(variant), "$.subjects", "variant")))


def subject_in(serialized: Column | str, word: str = "fiction", whole_word: bool = False) -> Column:
    """Whether serialized subjects hold ``word``.

    The default is a substring test ("nonfiction" passes); ``whole_word`` asks
    for a word boundary on both sides. Missing subjects give False.
    """
    if whole_word:
        hit = _col(serialized).rlike(rf"\b\Q{word.lower()}\E\b")
    else:
        hit = F.contains(_col(serialized), F.lit(word.lower()))
    return F.coalesce(hit, F.lit(False))


def subject_match(
    variant: Column | str, word: str = "fiction", whole_word: bool = False
) -> Column:
    """``subject_in`` of a parsed document."""
    return subject_in(subjects_text(variant), word, whole_word)


def text_match(columns: list[Column | str], query: Column | str) -> Column:
    """Case-insensitive literal substring match on any of ``columns``."""
    needle = F.lower(F.lit(query) if isinstance(query, str) else query)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(_col(c)), needle), F.lit(False))
    return hit
