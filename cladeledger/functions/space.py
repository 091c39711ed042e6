"""Space levels, size estimates and requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeledger import fixed_values as fixed


def level_rank(fraction: Column, free_bytes: Column | None = None) -> Column:
    """0 normal to 3 paused; a level applies only if fraction and bytes are both below its limit (FN-29)."""
    chain = None
    for rank in (3, 2, 1):
        name = fixed.LEVELS[rank]
        low = fraction < fixed.LEVEL_FRACTIONS[name]
        if free_bytes is not None:
            low = low & (free_bytes < fixed.LEVEL_BYTES[name])
        chain = F.when(low, rank) if chain is None else chain.when(low, rank)
    return chain.otherwise(0)


def level_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in fixed.LEVELS]), rank)


def two_volume_level(
    fraction_a: Column, bytes_a: Column, fraction_b: Column, bytes_b: Column
) -> Column:
    """The level of the smaller fraction and the smaller byte count of two volumes."""
    return level_name(level_rank(F.least(fraction_a, fraction_b), F.least(bytes_a, bytes_b)))


def footprint(size_bp: Column) -> Column:
    """Gigabases and the three disk estimates in GB (FN-19)."""
    gb = size_bp / F.lit(float(fixed.BASES_PER_GB))
    return F.struct(
        gb.alias("size_gb"),
        (gb * fixed.FOOTPRINT_COMPRESSED).alias("compressed_gb"),
        (gb * fixed.FOOTPRINT_FASTA).alias("fasta_gb"),
        (gb * fixed.FOOTPRINT_ANNOTATED).alias("annotated_gb"),
    )


def space_requirement(size_bytes: Column, workers: Column, temp_free: Column, output_free: Column, same_volume: Column) -> Column:
    """Peak need of a download and whether two volumes can hold it (FN-34)."""
    required = (size_bytes * (workers * fixed.PEAK_FACTOR)).cast("bigint")
    margin = (required * fixed.SAFETY_FACTOR).cast("bigint")
    temp_ok, output_ok = temp_free >= margin, output_free >= margin
    return F.struct(
        required.alias("required_bytes"),
        margin.alias("required_with_margin"),
        temp_ok.alias("temp_sufficient"),
        output_ok.alias("output_sufficient"),
        F.when(same_volume, F.least(temp_free, output_free) >= margin)
        .otherwise(temp_ok & output_ok)
        .alias("overall_sufficient"),
    )
