"""Species-name rules and names that are safe for directories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeledger.fixed_values import GENERIC_TERMS, SUBSPECIES_MARKERS, UNIDENTIFIED_MARKERS
from cladeledger.functions.text import literal_alternation, literal_array, literal_map, strip

VALID = "Valid"

_CHARACTERS = r"^[A-Za-z]+([\s-][A-Za-z]+)*$"
_BINOMIAL = r"^[A-Z][a-z]{2,} [a-z]{3,}(-[a-z]+)*$"
_EXCLUDED = (
    rf"(?i)\b(?:(?:{literal_alternation(SUBSPECIES_MARKERS + UNIDENTIFIED_MARKERS)})\.?"
    rf"|(?:{literal_alternation(GENERIC_TERMS)}))\b"
)


def single_spaced(name: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return strip(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f]+", " "))


def is_valid_binomial(name: Column) -> Column:
    """True for a two-word species name without markers or generic terms (FN-2)."""
    tidy = single_spaced(name)
    # The two-word pattern is stricter than the digit, character and word-count rules together.
    return F.coalesce(tidy.rlike(_BINOMIAL) & ~tidy.rlike(_EXCLUDED), F.lit(False))


def _marker_messages() -> dict[str, str]:
    lists = {
        "Contains subspecies marker: ": SUBSPECIES_MARKERS,
        "Contains unidentified marker: ": UNIDENTIFIED_MARKERS,
        "Contains generic term: ": GENERIC_TERMS,
    }
    messages: dict[str, str] = {}
    for label, words in lists.items():
        for word in words:
            messages.setdefault(word, label + word)
    return messages


def rejection_reason(name: Column) -> Column:
    """The first rule a name breaks, or ``Valid`` (FN-3).

    Each rule is one pattern on the whole name, which keeps the generated code small.
    """
    tidy = single_spaced(name)
    messages = _marker_messages()
    # Only letters, spaces and hyphens reach the markers, so a word-bounded marker is a whole part.
    parts = F.split(F.lower(tidy), "[ -]")
    marker = F.get(F.array_intersect(literal_array(messages), parts), F.lit(0))
    words = F.size(F.split(tidy, " ")).cast("string")
    return (
        F.when(name.isNull() | (name == ""), "Empty or invalid input")
        .when(tidy.rlike(r"(?U)\d"), "Contains numbers")
        .when(
            ~tidy.rlike(_CHARACTERS),
            "Contains invalid characters (only letters, spaces, hyphens allowed)",
        )
        .when(~tidy.rlike(" "), "Too few words (1), need exactly 2")
        .when(tidy.rlike(" .* "), F.concat(F.lit("Too many words ("), words, F.lit("), need exactly 2")))
        .when(~tidy.rlike("^[A-Z]"), "Genus name must start with uppercase letter")
        .when(tidy.rlike("^[^ ]*-"), "Genus name must not contain hyphens")
        .when(~tidy.rlike("^.[a-z]+ "), "Genus name must have lowercase letters after first")
        .when(tidy.rlike("^.. "), "Genus name too short (2 chars), need ≥3")
        .when(tidy.rlike(" .*[A-Z]"), "Specific epithet must be all lowercase")
        .when(tidy.rlike(" .$"), "Specific epithet too short (1 chars), need ≥3")
        .when(tidy.rlike(" ..$"), "Specific epithet too short (2 chars), need ≥3")
        .when(~tidy.rlike(_BINOMIAL), "Specific epithet format invalid")
        .otherwise(F.coalesce(F.element_at(literal_map(messages), marker), F.lit(VALID)))
    )


def safe_directory_name(taxon: Column) -> Column:
    """The directory a taxon is written to: letters, digits and ``_-.()``, at most 200 long (FN-15)."""
    tidy = F.btrim(F.regexp_replace(taxon, r"[^\p{L}\p{N}\-.()]+", "_"), F.lit("_"))
    cut = F.when(
        F.length(tidy) > 200, F.regexp_replace(F.substring(tidy, 1, 200), "_+$", "")
    ).otherwise(tidy)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown_taxon"))


def resume_directory_name(taxon: Column) -> Column:
    """The more permissive rule of older runs: only separators and reserved characters go."""
    tidy = F.btrim(F.regexp_replace(taxon, r'[ <>:"/\\|?*_]+', "_"), F.lit("_"))
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit("unknown_taxon"))


def _replaced(text: Column, character: str) -> Column:
    return F.replace(text, F.lit(character), F.lit("_"))


def ascii_file_name(name: Column) -> Column:
    """ASCII letters, digits and ``-_.`` only, at most 100 long."""
    kept = F.regexp_replace(_replaced(name, " "), r"[^A-Za-z0-9\-_.]+", "")
    return F.substring(F.coalesce(F.nullif(kept, F.lit("")), F.lit("unknown")), 1, 100)


def split_file_name(name: Column) -> Column:
    """The name part of second-level split files."""
    return _replaced(_replaced(name, " "), "/")


def is_numeric_id(taxon: Column) -> Column:
    """True when the text is a numeric taxon id (FN-31)."""
    return F.coalesce(strip(taxon).rlike(r"(?U)^\d+$"), F.lit(False))
