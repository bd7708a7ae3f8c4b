"""Names, paths and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allowed characters of class folders and geometry ids, and the id limit.
SAFE_CHARACTERS = "A-Za-z0-9._-"
GEOMETRY_ID_LIMIT = 64
SHA256_PATTERN = "^[0-9a-f]{64}$"


def class_folder(kind: Column) -> Column:
    cleaned = F.regexp_replace(kind, f"[^{SAFE_CHARACTERS}]", "_")
    return F.when(F.length(cleaned) == 0, F.lit("unknown")).otherwise(cleaned)


def crop_name(frame_id: Column, target_index: Column) -> Column:
    return F.format_string("f%06d_d%d", frame_id.cast("bigint"), target_index.cast("bigint"))


def target_id(target_index: Column) -> Column:
    return F.concat(F.lit("d"), target_index.cast("string"))


def source_id(frame_id: Column, target_index: Column) -> Column:
    return F.concat_ws(":", F.lit("detection"), frame_id.cast("string"), target_index.cast("string"))


def valid_geometry_id(value: Column) -> Column:
    return value.rlike(f"^[{SAFE_CHARACTERS}]+$") & (F.length(value) < GEOMETRY_ID_LIMIT)


def valid_digest(value: Column) -> Column:
    return value.rlike(SHA256_PATTERN)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path part with its dot; empty when there is none.

    A leading dot alone starts a hidden name and is not a suffix.
    """
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root``; the file name when the path is elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(
        file_name(path)
    )


def extension_set(text: Column) -> Column:
    """``"jpg, .PNG"`` to ``[".jpg", ".png"]``: trimmed, lower-cased, dotted, without repeats."""
    parts = F.transform(F.split(text, ","), lambda item: F.lower(F.trim(item, F.lit(" \t"))))
    kept = F.filter(parts, lambda item: F.length(item) > 0)
    dotted = F.transform(
        kept, lambda item: F.when(F.startswith(item, F.lit(".")), item).otherwise(F.concat(F.lit("."), item))
    )
    return F.array_sort(F.array_distinct(dotted))
