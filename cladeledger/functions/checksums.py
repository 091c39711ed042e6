"""Checksum lines, paths inside a checked tree, hashes and file states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import (
    ERROR,
    FAIL,
    MISSING,
    PACKAGE_PREFIXES,
    PASS,
    UNMAPPED_DATA_EXTENSIONS,
)
from cladeledger.functions.text import (
    basename,
    dirname,
    literal_alternation,
    none_if_empty,
    strip,
    suffix,
)

DIALECTS = ("strict", "flat", "package", "loose", "lower", "lenient")

# The forms of a checksum line. A path may hold any character but an end of line.
_TOKENS = r"(?s)^(\S+)\s+(.+)$"
_STRICT = r"(?s)^([0-9a-fA-F]{32})\s+\*?(.+)$"
_BSD = r"(?s)^MD5\s*\((.+?)\)\s*=\s*([a-fA-F0-9]{32})$"
_URI_ROOT = "^([a-z][a-z0-9+.-]*://[^/]*)"
_CHUNK_BYTES = 1 << 20


def _without_star(path: Column) -> Column:
    return F.regexp_replace(path, r"^\*", "")


def parse_checksum_line(line: Column, dialect: str = "strict") -> Column:
    """``struct<hash, path>`` of one line, or null for comments and bad lines (FN-17).

    ``strict``: 32 hex digits, hash in lower case. ``flat``: any 32 characters and a bare file name.
    ``package``: any 32 characters and a path. ``loose``: any two fields. ``lower``: as loose, hash in
    lower case. ``lenient``: 32 hex digits, also ``MD5 (path) = hash``.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}, use one of {DIALECTS}")
    text = strip(line)
    content = (text != "") & ~F.startswith(text, F.lit("#"))
    first = F.regexp_extract(text, _TOKENS, 1)
    rest = _without_star(F.regexp_extract(text, _TOKENS, 2))
    forward = F.translate(rest, "\\", "/")
    if dialect == "strict":
        digest, path = F.lower(F.regexp_extract(text, _STRICT, 1)), strip(F.regexp_extract(text, _STRICT, 2))
        good = digest != ""
    elif dialect == "flat":
        digest, path = first, forward
        good = (F.length(first) == 32) & ~F.contains(forward, F.lit("/"))
    elif dialect == "package":
        digest, path = first, forward
        good = F.length(first) == 32
    elif dialect == "loose":
        digest, path = first, forward
        good = first != ""
    elif dialect == "lower":
        digest, path = F.lower(first), forward
        good = first != ""
    else:
        bsd = F.regexp_extract(text, _BSD, 2)
        digest = F.when(bsd != "", bsd).otherwise(first)
        path = F.when(bsd != "", F.regexp_extract(text, _BSD, 1)).otherwise(rest)
        good = (bsd != "") | first.rlike("^[a-fA-F0-9]{32}$")
    return F.when(content & good, F.struct(digest.alias("hash"), path.alias("path")))


def normal_path(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts; a URI keeps its scheme and host."""
    def step(parts: Column, part: Column) -> Column:
        up = F.when(F.size(parts) > 0, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        return (
            F.when(part.isin("", "."), parts)
            .when(part == "..", up)
            .otherwise(F.concat(parts, F.array(part)))
        )

    root = F.regexp_extract(path, _URI_ROOT, 1)
    parts = F.split(F.regexp_replace(path, _URI_ROOT, ""), "/")
    folded = F.concat(
        root, F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    )
    # Most paths are already normal; only the others pay for the fold.
    plain = path.rlike(r"^(/(?!\.{1,2}(/|$))[^/]+)+$")
    return F.when(plain, path).otherwise(folded)


def resolve_path(directory: Column, path: Column) -> Column:
    """``path`` below ``directory`` unless it is absolute, made normal."""
    absolute = path.rlike(r"^(/|[a-z][a-z0-9+.-]*://)")
    return normal_path(F.when(absolute, path).otherwise(F.concat(directory, F.lit("/"), path)))


def resolve_inside(root: Column, path: Column) -> Column:
    """The resolved path, or null when it lies outside ``root`` (FN-23)."""
    resolved, base = resolve_path(root, path), normal_path(root)
    return F.when((resolved == base) | F.startswith(resolved, F.concat(base, F.lit("/"))), resolved)


def display_path(root: Column, absolute: Column, written: Column) -> Column:
    """The path relative to ``root``, or as written in the list (FN-24)."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(absolute, prefix), F.substr(absolute, F.length(prefix) + 1)
    ).otherwise(written)


def unquoted(path: Column) -> Column:
    return F.translate(F.btrim(strip(path), F.lit("\"'")), "\\", "/")


def strip_package_prefix(path: Column) -> Column:
    """The path without the first known package prefix, else without leading slashes (FN-16)."""
    return F.regexp_replace(unquoted(path), f"^(?:{literal_alternation(PACKAGE_PREFIXES)}|/+)", "")


def split_relative_path(path: Column) -> Column:
    """``struct<directory, name>`` with ``.`` for a flat path (FN-22)."""
    return F.struct(dirname(path).alias("directory"), basename(path).alias("name"))


def task_id(root: Column, directory: Column, file_name: Column, expected_hash: Column) -> Column:
    """Stable id of a repair task (FN-21)."""
    zero = F.lit("\0")
    return F.sha2(
        F.concat(root, zero, directory, zero, file_name, zero, F.coalesce(expected_hash, F.lit(""))), 256
    )


def file_state(expected: Column, computed: Column, exists: Column, error: Column | None = None) -> Column:
    """pass, fail, missing or error (FN-25)."""
    failed = F.lit(False) if error is None else error.isNotNull()
    return (
        F.when(~exists, MISSING)
        .when(failed | computed.isNull(), ERROR)
        .when(computed == expected, PASS)
        .otherwise(FAIL)
    )


def file_state_message(state: Column, absolute: Column, error: Column) -> Column:
    """The message that goes with a state; null for pass and fail."""
    return F.when(state == MISSING, F.concat(F.lit("File not found: "), absolute)).when(
        state == ERROR, F.coalesce(error, F.lit("Unexpected error: no hash"))
    )


def unmapped_entry_name(path: Column, exists: Column) -> Column:
    """The name kept for a checksum entry when no rename mapping exists, else null (FN-33)."""
    name = none_if_empty(basename(F.rtrim(strip_package_prefix(path), F.lit("/"))))
    is_data = F.lower(suffix(name)).isin(*UNMAPPED_DATA_EXTENSIONS)
    return F.when(~name.isin(".", "..") & (exists | is_data), name)


def hash_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add ``computed_hash`` and ``error`` by reading each file in chunks, in parallel (FN-20).

    Files of any size are read in chunks; a failure becomes a row value and does not fail the job.
    """
    from pyspark.sql.types import StringType, StructType

    schema = StructType(list(paths.schema.fields)).add("computed_hash", StringType()).add("error", StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [file_md5(path) for path in batch[column]]
            yield batch.assign(
                computed_hash=[r[0] for r in results], error=[r[1] for r in results]
            )

    return paths.mapInPandas(run, schema)


def file_md5(path: str) -> tuple[str | None, str | None]:
    from pyarrow.fs import FileSystem

    digest = hashlib.md5()
    try:
        system, inner = FileSystem.from_uri(path)
        with system.open_input_stream(inner) as stream:
            while chunk := stream.read(_CHUNK_BYTES):
                digest.update(chunk)
    except PermissionError as problem:
        return None, f"Permission denied: {problem}"
    except OSError as problem:
        return None, f"I/O error: {problem}"
    except Exception as problem:
        return None, f"Unexpected error: {problem}"
    return digest.hexdigest(), None
