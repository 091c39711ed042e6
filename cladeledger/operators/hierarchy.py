"""Taxonomy hierarchy: edges, closure and roll-up of genome sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import RANKS
from cladeledger.functions.text import literal_array
from cladeledger.workspace import materialize

# Accession prefix of each data source.
SOURCE_PREFIXES = {"refseq": "GCF_", "genbank": "GCA_", "all": None}


def filter_source(genomes: DataFrame, source: str = "all") -> DataFrame:
    """Genomes of a data source by accession prefix (FN-1)."""
    if source.lower() not in SOURCE_PREFIXES:
        raise ValueError(f"invalid source {source!r}, use one of {sorted(SOURCE_PREFIXES)}")
    prefix = SOURCE_PREFIXES[source.lower()]
    return genomes if prefix is None else genomes.filter(F.startswith("accession", F.lit(prefix)))


def nodes_at_rank(nodes: DataFrame, rank: str) -> DataFrame:
    """Nodes whose rank equals ``rank``, ignoring case (GR-3)."""
    return nodes.filter(F.upper("rank") == rank.upper())


def edges(nodes: DataFrame) -> DataFrame:
    """Distinct (parent, child) pairs (GR-1)."""
    return nodes.select(F.explode("parent_ids").alias("parent"), F.col("tax_id").alias("child")).distinct()


@dataclass(frozen=True)
class Jumps:
    """``steps[k]`` has the pairs (``parent``, ``child``) that 2^k links join, as long as there are any."""

    steps: list[DataFrame]
    one_parent: bool
    cyclic: bool

    @property
    def is_forest(self) -> bool:
        return self.one_parent and not self.cyclic


def jumps(edge_pairs: DataFrame) -> Jumps:
    """Path doubling: each table is the one before joined with itself, so there are as many as the longest path has binary digits.

    With one parent per node a table has at most one row per node. Without cycles the tables run out; with one they
    stop once a path would be longer than there are links.
    """
    links = materialize(edge_pairs.filter("parent <> child").select("parent", "child").distinct(), "edges")
    most, longest = links.groupBy("child").count().agg(F.max("count"), F.sum("count")).first()
    one_parent, steps, step = most == 1, [], links
    while longest and not step.isEmpty():
        steps.append(step)
        if 1 << len(steps) > longest:
            # A path of as many links as there are would have to meet a node again, unless it takes them all.
            return Jumps(steps, one_parent, not _doubled(step, one_parent).isEmpty())
        step = _doubled(step, one_parent)
    return Jumps(steps, one_parent, False)


def _doubled(step: DataFrame, one_parent: bool) -> DataFrame:
    onward = step.select(F.col("parent").alias("child"), F.col("child").alias("beyond"))
    found = step.join(onward, "child").select("parent", F.col("beyond").alias("child"))
    return materialize(found if one_parent else found.distinct(), "jumps")


def closure(edge_pairs: DataFrame, ancestors: DataFrame, found: Jumps | None = None) -> DataFrame:
    """(ancestor, descendant) for each given ancestor, itself included (GR-2).

    Round *k* extends all pairs known so far by 2^k links at once, so rounds grow with the logarithm of the depth. In a
    forest each pair is met once; otherwise pairs already known are dropped, which also ends on cycles.
    """
    found = jumps(edge_pairs) if found is None else found
    known = materialize(
        ancestors.select(F.col("tax_id").alias("ancestor"), F.col("tax_id").alias("descendant")).distinct(),
        "closure",
    )
    for step in found.steps:
        reached = known.join(step, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant"))
        if not found.is_forest:
            reached = reached.distinct().join(known, ["ancestor", "descendant"], "left_anti")
        known = known.unionByName(materialize(reached, "closure"))
    return known


def genomes_per_taxon(genomes: DataFrame) -> DataFrame:
    """Genome count and summed length per taxon id (JN-1)."""
    return genomes.groupBy("tax_id").agg(
        F.count("*").alias("n_genomes"), F.sum("sequence_length").alias("size_bp")
    )


def genomes_below(pairs: DataFrame, genomes: DataFrame) -> DataFrame:
    """The genomes of each ancestor and all its descendants (JN-2)."""
    return pairs.join(genomes, F.col("descendant") == F.col("tax_id")).select(
        F.col("ancestor").alias("taxon_id"), *genomes.columns
    )


def roll_up(pairs: DataFrame, genomes: DataFrame) -> DataFrame:
    """Size, genome count and where the genomes sit, per ancestor with genomes (GR-5, AG-2, AG-3).

    Genomes are summed per taxon before the join, so a taxon with very many genomes is one row there.
    """
    per_taxon = genomes_per_taxon(genomes)
    direct = F.col("ancestor") == F.col("descendant")
    return (
        pairs.join(per_taxon, F.col("descendant") == F.col("tax_id"))
        .groupBy(F.col("ancestor").alias("tax_id"))
        .agg(
            F.sum("size_bp").alias("size_bp"),
            F.sum("n_genomes").alias("n_genomes"),
            F.bool_or(direct).alias("has_direct"),
            F.bool_or(~direct).alias("has_below"),
        )
    )


def roll_up_forest(found: Jumps, ancestors: DataFrame, genomes: DataFrame) -> DataFrame:
    """As ``roll_up``, without pairs: in a forest every node's sums are those of its next 2^k generations, which double.

    Each round writes at most one row per node that has genomes below it.
    """
    if not found.is_forest:
        raise ValueError("nodes with several parents or cycles need the closure")
    own = genomes_per_taxon(genomes).filter("tax_id IS NOT NULL")
    sums = own.select("tax_id", "size_bp", "n_genomes", F.lit(True).alias("has_direct"), F.lit(False).alias("has_below"))
    for step in found.steps:
        below = sums.join(step, F.col("tax_id") == F.col("child")).select(
            F.col("parent").alias("tax_id"), "size_bp", "n_genomes", F.lit(False).alias("has_direct"), F.lit(True).alias("has_below")
        )
        both = sums.unionByName(below).groupBy("tax_id")
        sums = materialize(
            both.agg(
                F.sum("size_bp").alias("size_bp"), F.sum("n_genomes").alias("n_genomes"),
                F.bool_or("has_direct").alias("has_direct"), F.bool_or("has_below").alias("has_below"),
            ),
            "sums",
        )
    return sums.join(ancestors.select("tax_id").distinct(), "tax_id", "left_semi")


def descendants_with_genomes(pairs: DataFrame, nodes: DataFrame, genomes: DataFrame) -> DataFrame:
    """Strict descendants that have a node and genomes of their own (JN-3)."""
    own = genomes.select("tax_id").distinct()
    named = nodes.select(F.col("tax_id").alias("descendant"), "name").join(
        own.withColumnRenamed("tax_id", "descendant"), "descendant", "left_semi"
    )
    return pairs.filter("ancestor <> descendant").join(named, "descendant").select("ancestor", "descendant", "name")


def rank_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per rank, known ranks in order, then the others by name (AG-1)."""
    place = F.nullif(F.array_position(literal_array(RANKS), F.col("rank")), F.lit(0))
    return (
        nodes.groupBy(F.upper("rank").alias("rank"))
        .agg(F.count("*").alias("n_nodes"))
        .filter("rank <> ''")
        .withColumn("place", F.coalesce(place, F.lit(99)).cast("bigint"))
        .orderBy("place", "rank")
    )


def taxon_at_rank(ids: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """Name and id at ``rank`` from the classification, or ``unknown_<rank>`` and -1 (FN-18)."""
    key = rank.lower()
    found = F.col("classification")[key]
    return ids.join(nodes.select("tax_id", "classification"), "tax_id", "left").select(
        "tax_id",
        F.when(found.isNull(), f"unknown_{key}").otherwise(found["name"]).alias("taxon_name"),
        F.when(found.isNull(), -1).otherwise(found["id"]).cast("bigint").alias("taxon_id"),
    )
