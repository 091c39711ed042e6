"""Split planning: catalogue and taxonomy to groups, exceeded taxa, accession bins and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import BASES_PER_GB
from cladeledger.functions.names import is_valid_binomial
from cladeledger.operators import hierarchy
from cladeledger.operators.packing import CHUNK_ROWS, pack, pack_all
from cladeledger.operators.reports import split_totals
from cladeledger.sinks import splits
from cladeledger.workspace import materialize


@dataclass(frozen=True)
class SplitPlan:
    packed: DataFrame
    below: DataFrame
    accession_bins: DataFrame
    totals: DataFrame


def sized_taxa(nodes: DataFrame, genomes: DataFrame, pairs: DataFrame, names: bool) -> DataFrame:
    """Taxa with genomes: name, size, counts; optionally only proper species names."""
    sizes = hierarchy.roll_up(pairs, genomes).filter("size_bp > 0")
    named = sizes.join(nodes.select("tax_id", "name"), "tax_id")
    return named.filter(is_valid_binomial(F.col("name"))) if names else named


def plan_split(
    nodes: DataFrame,
    genomes: DataFrame,
    rank: str,
    split_size_gb: float,
    source: str = "all",
    names_only: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> SplitPlan:
    """Pack the taxa of a rank into groups of at most ``split_size_gb`` gigabases (PL-1).

    Taxa larger than that are packed by accession instead.
    """
    capacity = int(split_size_gb * BASES_PER_GB)
    columns = ["accession", "tax_id", "sequence_length"]
    chosen = materialize(hierarchy.filter_source(genomes, source).select(*columns), "genomes")
    # Read four times from here on, so the taxonomy is parsed once.
    nodes = materialize(nodes.select("tax_id", "name", "rank", "parent_ids"), "nodes")
    pairs = hierarchy.closure(hierarchy.edges(nodes), hierarchy.nodes_at_rank(nodes, rank))
    taxa = sized_taxa(nodes, chosen, pairs, names_only)
    packed = pack(taxa, capacity, chunk_rows=chunk_rows)
    exceeded = packed.filter(F.col("size_bp") > capacity).select(F.col("tax_id").alias("ancestor"), "name")
    members = pairs.join(exceeded, "ancestor")
    accessions = (
        hierarchy.genomes_below(members.select("ancestor", "descendant"), chosen)
        .select("taxon_id", "accession", "sequence_length")
        .join(exceeded.withColumnRenamed("ancestor", "taxon_id"), "taxon_id")
    )
    bins = pack_all(accessions, capacity, "sequence_length", "accession", ["taxon_id"], chunk_rows)
    below = hierarchy.descendants_with_genomes(pairs, nodes, chosen)
    return SplitPlan(packed, below, bins, split_totals(packed))


def write_split(plan: SplitPlan, path: str, config: dict[str, object]) -> None:
    """Group files, exceeded list, accession files and summary below ``path``."""
    splits.write_groups(plan.packed, plan.below, f"{path}/groups")
    if splits.write_exceeded(plan.packed, f"{path}/exceeded"):
        splits.write_accession_bins(plan.accession_bins, f"{path}/accessions")
    splits.write_summary(plan.totals, config, f"{path}/summary")
