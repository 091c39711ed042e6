"""Output of split planning: group files, exceeded lists, second-level files and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import FOOTPRINT_ANNOTATED, FOOTPRINT_COMPRESSED, FOOTPRINT_FASTA
from cladeledger.functions.names import split_file_name
from cladeledger.functions.space import footprint
from cladeledger.sinks.lines import REPORT_ORDER, exploded, fixed_lines, write_lines


def group_lines(packed: DataFrame, below: DataFrame) -> DataFrame:
    """Lines of all group files: header, taxon, its descendants by name, blank line (SNK-1, SO-2)."""
    taxa = packed.filter("bin IS NOT NULL").select(
        F.col("bin").alias("group_id"), (-F.col("size_bp")).alias("rank_size"), "tax_id", "name"
    )
    tab = F.lit("\t")
    own = taxa.select(
        "group_id", "rank_size", "tax_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.concat(F.lit("# Species: "), "name", F.lit(" ("), "tax_id", F.lit(")")).alias("line")),
                F.struct(F.lit(1).alias("part"), F.concat("name", tab, "tax_id").alias("line")),
                F.struct(F.lit(3).alias("part"), F.lit("").alias("line")),
            )
        ).alias("l"),
    ).select("group_id", "rank_size", "tax_id", "l.part", F.lit("").alias("child"), F.lit(0).cast("bigint").alias("child_id"), "l.line")
    children = taxa.drop("name").join(
        below.select(F.col("ancestor").alias("tax_id"), F.col("name").alias("child"), F.col("descendant").alias("child_id")),
        "tax_id",
    ).select("group_id", "rank_size", "tax_id", F.lit(2).alias("part"), "child", "child_id", F.concat("child", tab, "child_id").alias("line"))
    return own.unionByName(children)


GROUP_ORDER = ("rank_size", "tax_id", "part", "child", "child_id")


def write_groups(packed: DataFrame, below: DataFrame, path: str) -> None:
    write_lines(group_lines(packed, below), path, GROUP_ORDER, folder="group_id")


def exceeded_lines(packed: DataFrame) -> DataFrame:
    """name, id and size of the taxa that fit no group (SNK-2)."""
    return packed.filter("bin IS NULL").select("tax_id", F.concat_ws("\t", "name", "tax_id", "size_bp").alias("line"))


def write_exceeded(packed: DataFrame, path: str) -> bool:
    """Write the exceeded list; nothing is written when it is empty."""
    lines = exceeded_lines(packed)
    if lines.isEmpty():
        return False
    write_lines(lines, path, ["tax_id"])
    return True


def write_accession_bins(binned: DataFrame, path: str) -> None:
    """One file set per exceeded taxon and bin, named by taxon and id (SNK-3)."""
    name = F.concat(split_file_name(F.col("name")), F.lit("_"), "taxon_id", F.lit("_"), "bin")
    lines = binned.select(
        name.alias("file"), (-F.col("sequence_length")).alias("rank_size"), "accession", F.col("accession").alias("line")
    )
    write_lines(lines, path, ["rank_size", "accession"], folder="file")


def _gb(value: Column) -> Column:
    return F.format_string("%.2f", F.bround(value, 2))


def _disk(size_gb: Column, factor: float) -> Column:
    return F.concat(F.lit("~"), F.format_string("%.0f", F.bround(size_gb * factor, 0)), F.lit(" GB"))


def summary_lines(totals: DataFrame, config: dict[str, object]) -> DataFrame:
    """The split summary as lines; ``totals`` comes from ``split_totals`` (SNK-4)."""
    spark = totals.sparkSession
    sized = totals.withColumn("gb", footprint(F.col("size_bp"))["size_gb"])
    # Headings and labels of the split summary.
    head = [f"# Task Split Results: {config.get('taxon', '')}", "", "## Configuration", ""]
    head += [f"- **{k}**: {v}" for k, v in config.items()]
    head += ["", "## Overall Statistics", "", "| Metric | Value |", "|--------|-------|"]

    def row(*cells: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def count(name: str) -> Column:
        return F.format_number(name, 0)

    def figures(level: str, species: str) -> list[Column]:
        return [
            row(F.lit(species), count("n_species")),
            row(F.lit("Total Genomes"), count("n_genomes")),
            row(F.lit("Total Size"), F.concat(_gb(F.col("gb")), F.lit(" Gb"))),
        ]

    disk = [
        row(F.lit("FASTA.GZ (compressed)"), _disk(F.col("gb"), FOOTPRINT_COMPRESSED)),
        row(F.lit("FASTA (uncompressed)"), _disk(F.col("gb"), FOOTPRINT_FASTA)),
        row(F.lit("GenBank (with annotations)"), _disk(F.col("gb"), FOOTPRINT_ANNOTATED)),
    ]
    group = row(
        F.concat(F.lit("group"), "group_id"), count("n_species"), count("n_genomes"), _gb(F.col("gb")),
        *[_disk(F.col("gb"), f) for f in (FOOTPRINT_COMPRESSED, FOOTPRINT_FASTA, FOOTPRINT_ANNOTATED)],
    )
    number = F.format_string("%020d", F.col("group_id"))
    table = F.lit("| Metric | Value |"), F.lit("|--------|-------|")
    files = totals.agg(
        F.count_if(F.col("level") == "group").alias("groups"),
        F.coalesce(F.max(F.when(F.col("level") == "exceeded", F.col("n_species"))), F.lit(0)).alias("exceeded"),
    )
    listed = [
        F.concat(F.lit("- **Main Groups**: "), F.col("groups").cast("string"), F.lit(" files")),
        F.concat(F.lit("- **Exceeded Taxons**: "), F.col("exceeded").cast("string"), F.lit(" taxa")),
        F.when(F.col("exceeded") > 0, F.lit("- **Secondary Splits**: accession files for each exceeded taxon")),
    ]
    exceeded = [F.lit(""), F.lit("## Exceeded Taxons"), F.lit(""), *table, *figures("exceeded", "Exceeded Taxons")]
    return (
        fixed_lines(spark, 0, head)
        .unionByName(exploded(sized.filter("level = 'overall'"), 1, F.lit(""), figures("overall", "Total Species")))
        .unionByName(fixed_lines(spark, 2, ["", "### Estimated Disk Space", "", "| Format | Estimated Disk Space |", "|--------|-------|"]))
        .unionByName(exploded(sized.filter("level = 'overall'"), 3, F.lit(""), disk))
        .unionByName(fixed_lines(spark, 4, ["", "## Group Details", "", "| Group | Species | Genomes | Size (Gb) | FASTA.GZ | FASTA | GenBank |", "|---|---|---|---|---|---|---|"]))
        .unionByName(exploded(sized.filter("level = 'group'"), 5, number, [group]))
        .unionByName(exploded(sized.filter("level = 'exceeded' AND n_species > 0"), 6, F.lit(""), exceeded))
        .unionByName(fixed_lines(spark, 7, ["", "## Understanding Size Units", "", SIZE_UNITS, "", "## Output Files", ""]))
        .unionByName(exploded(files, 8, F.lit(""), listed))
        .unionByName(fixed_lines(spark, 9, ["", "### File Formats", "", *FILE_FORMATS]))
    )


SIZE_UNITS = "Sizes are in Gb (gigabases), the length of the sequences in units of 10^9 bases, not space on disk."
FILE_FORMATS = [
    "- Group files: a comment line for each taxon, then name, tab and id of the taxon and of all below it that have genomes, then an empty line.",
    "- Exceeded list: name, id and size in bases of each taxon, with tabs between them.",
    "- Secondary files: one accession per line.",
]


def write_summary(totals: DataFrame, config: dict[str, object], path: str) -> None:
    write_lines(summary_lines(totals, config), path, REPORT_ORDER)
