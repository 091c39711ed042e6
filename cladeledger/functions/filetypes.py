"""Include types of data files and the names they are stored under."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeledger.fixed_values import (
    EXTENSION_SPELLINGS,
    INCLUDE_EXTENSIONS,
    METADATA_NAMES,
    OUTPUT_EXTENSIONS,
)
from cladeledger.functions.accessions import loose_accession
from cladeledger.functions.text import basename, literal_array, literal_map, suffix

DEFAULT_INCLUDE = ("genome",)


def include_types(requested: Sequence[str] | None) -> list[str]:
    """The requested include types of a run: known ones, each once, ``genome`` by default."""
    if not requested or "none" in requested:
        return list(DEFAULT_INCLUDE)
    known = [t for t in dict.fromkeys(requested) if t in INCLUDE_EXTENSIONS]
    return known or list(DEFAULT_INCLUDE)


def normalized_include(requested: Column) -> Column:
    """The same rule on an array column (FN-10)."""
    default = literal_array(DEFAULT_INCLUDE)
    known = F.array_distinct(F.filter(requested, lambda t: t.isin(*INCLUDE_EXTENSIONS)))
    empty = requested.isNull() | (F.size(requested) == 0)
    return F.when(
        empty | F.array_contains(requested, "none") | (F.size(known) == 0), default
    ).otherwise(known)


def file_specs(requested: Column) -> Column:
    """Array of (include_type, extensions) of a normalised include array."""
    table = F.create_map(
        *[x for t, exts in INCLUDE_EXTENSIONS.items() for x in (F.lit(t), literal_array(exts))]
    )
    return F.transform(
        normalized_include(requested),
        lambda t: F.struct(t.alias("include_type"), F.element_at(table, t).alias("extensions")),
    )


def include_extensions(requested: Column) -> Column:
    """Sorted distinct extensions of an include array (FN-11)."""
    table = F.create_map(
        *[x for t, exts in INCLUDE_EXTENSIONS.items() for x in (F.lit(t), literal_array(exts))]
    )
    wanted = F.coalesce(requested, F.array().cast("array<string>"))
    found = F.flatten(
        F.transform(F.filter(wanted, lambda t: t.isin(*INCLUDE_EXTENSIONS)), lambda t: F.element_at(table, t))
    )
    genome = literal_array(INCLUDE_EXTENSIONS["genome"])
    with_default = F.when(
        (F.size(found) == 0) | F.array_contains(wanted, "none"), F.concat(found, genome)
    ).otherwise(found)
    return F.array_sort(F.array_distinct(with_default))


def file_type(path: Column, allowed: Sequence[str] | None = None) -> Column:
    """Include type from the file name, null for other files or types not allowed (FN-6)."""
    name = F.lower(basename(path))
    found = (
        F.when(name.isin(*METADATA_NAMES), F.lit(None))
        .when(F.endswith(name, F.lit(".faa")), "protein")
        .when(F.contains(name, F.lit("cds")), "cds")
        .when(F.contains(name, F.lit("rna")), "rna")
        .when(name.rlike(r"\.gff3?$"), "gff3")
        .when(F.endswith(name, F.lit(".gtf")), "gtf")
        .when(name.rlike(r"\.(gbff|gb)$"), "gbff")
        .when(name.rlike(r"\.jsonl$|sequence_report"), "seq-report")
        .when(name.rlike(r"\.(fna|fa|fasta)$"), "genome")
    )
    if allowed is None:
        return found
    kept = literal_map({t: t for t in include_types(allowed)})
    return F.element_at(kept, found)


def output_extension(path: Column, include_type: Column | None = None) -> Column:
    """The extension a file is stored under (FN-7)."""
    name = F.lower(basename(path))
    is_cds, is_rna = F.contains(name, F.lit("cds")), F.contains(name, F.lit("rna"))
    if include_type is not None:
        is_cds, is_rna = is_cds | (include_type == "cds"), is_rna | (include_type == "rna")
    written = suffix(name)
    spelled = F.coalesce(F.element_at(literal_map(EXTENSION_SPELLINGS), written), written)
    return F.when(is_cds, ".cds").when(is_rna, ".rna.fna").otherwise(spelled)


def standard_name(path: Column, accession: Column | None = None, include_type: Column | None = None) -> Column:
    """``accession`` plus output extension; null without an accession (FN-8).

    A type found from the name never changes the extension, so only a given type is looked at.
    """
    known = loose_accession(path) if accession is None else F.coalesce(accession, loose_accession(path))
    return F.concat(known, output_extension(path, include_type))


def expected_names(accession: Column, requested: Column) -> Column:
    """Array of (include_type, filename) an accession should have (FN-9)."""
    table = literal_map(OUTPUT_EXTENSIONS)
    return F.transform(
        normalized_include(requested),
        lambda t: F.struct(
            t.alias("include_type"), F.concat(accession, F.element_at(table, t)).alias("filename")
        ),
    )


def type_of_standard_name(name: Column) -> Column:
    """Include type of a stored name; ``genome`` when nothing else fits (FN-12)."""
    chain = None
    for extension, kind in [
        (".faa", "protein"), (".cds", "cds"), (".rna.fna", "rna"), (".gff", "gff3"),
        (".gtf", "gtf"), (".gbff", "gbff"), (".jsonl", "seq-report"),
    ]:
        test = F.endswith(name, F.lit(extension))
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("genome")
