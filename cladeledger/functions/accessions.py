"""Accession and extension extraction from paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeledger.functions.text import basename, none_if_empty

# The strict form has nine digits in any case, the loose one any number of digits.
STRICT_ACCESSION = r"(?i)(GC[FA]_[0-9]{9}\.[0-9]+)"
LOOSE_ACCESSION = r"(GC[AF]_[0-9]+\.[0-9]+)"


def strict_accession(path: Column) -> Column:
    """First strict accession in upper case, or null (FN-4)."""
    return F.upper(none_if_empty(F.regexp_extract(path, STRICT_ACCESSION, 1)))


def strict_accession_of(path: Column, file_name: Column) -> Column:
    return F.coalesce(strict_accession(path), strict_accession(file_name))


def loose_accession(path: Column) -> Column:
    """First loose accession in a path, or null (FN-5)."""
    return none_if_empty(F.regexp_extract(path, LOOSE_ACCESSION, 1))


def file_extension(name: Column) -> Column:
    """The extension, with ``.tar.gz`` as one; empty if there is none (FN-14)."""
    return F.regexp_extract(basename(name), r"^.+?((?i:\.tar\.gz)|\.[^.]+)$", 1)


def simplified_name(name: Column) -> Column:
    """Accession as written plus extension; the name itself without an accession (FN-13)."""
    accession = none_if_empty(F.regexp_extract(name, STRICT_ACCESSION, 1))
    return F.coalesce(F.concat(accession, file_extension(name)), name)
