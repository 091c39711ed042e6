"""Genome catalogue tables (TSV) and taxonomy reports (JSON Lines)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.functions.text import strip
from cladeledger.operators.dedup import last_wins
from cladeledger.sources.lines import position

# Column names of a catalogue file.
CATALOGUE_COLUMNS = {
    "accession": "Assembly Accession",
    "organism_name": "Organism Name",
    "tax_id": "Organism Taxonomic ID",
    "sequence_length": "Assembly Stats Total Sequence Length",
}

# Field names of a taxonomy report.
TAXONOMY_SCHEMA = """
taxonomy STRUCT<
  taxId: BIGINT,
  rank: STRING,
  currentScientificName: STRUCT<name: STRING>,
  classification: MAP<STRING, STRUCT<name: STRING, id: BIGINT>>,
  parents: ARRAY<BIGINT>,
  children: ARRAY<BIGINT>>
"""


def read_catalogue(spark: SparkSession, path: str | list[str], mode: str = "strict") -> DataFrame:
    """Rows with accession, organism_name, tax_id and sequence_length (SRC-1).

    Columns are found by name, also when files of one call have them in different places. Incomplete rows are
    skipped. A value that is not a number fails the job with file and row in
    ``strict`` mode and drops the row in ``permissive`` mode.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError("mode is 'strict' or 'permissive'")
    text = reduce(DataFrame.unionByName, [_by_name(spark, paths) for paths in _same_headers(spark, path)])
    text = text.filter("accession <> '' AND tax_id <> '' AND sequence_length <> ''")

    def number(name: str) -> Column:
        value = F.expr(f"try_cast({name} AS BIGINT)")
        if mode == "permissive":
            return value.alias(name)
        problem = F.raise_error(
            F.format_string("%s: accession %s has %s '%s'", "file", "accession", F.lit(name), name)
        )
        return F.coalesce(value, problem.cast("bigint")).alias(name)

    rows = text.select(
        "accession",
        F.coalesce("organism_name", F.lit("")).alias("organism_name"),
        number("tax_id"),
        number("sequence_length"),
    )
    return rows if mode == "strict" else rows.dropna(subset=["tax_id", "sequence_length"])


def _same_headers(spark: SparkSession, path: str | list[str]) -> list[str | list[str]]:
    """The files in groups of equal header lines, since Spark reads the files of one scan by position.

    Only the first line of each file comes to the driver, which lists the files for the scan anyway.
    """
    first = spark.read.text(path).select("value", position().alias("line")).filter("line.block = 0")
    headers = first.groupBy("line.file").agg(F.min_by("value", "line.row").alias("header"))
    # The path comes percent-encoded, with a plus sign as it is; the readers take it plain, but for glob characters.
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    headers = headers.withColumn("file", F.regexp_replace(plain, r"([\\{}\[\]*?])", r"\\$1"))
    groups = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [r["files"] for r in groups] if len(groups) > 1 else [path]


def _by_name(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return raw.select(
        *[strip(F.col(f"`{column}`")).alias(name) for name, column in CATALOGUE_COLUMNS.items()],
        F.col("_metadata.file_path").alias("file"),
    )


def read_taxonomy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per taxon id, the last line of an id winning (SRC-2)."""
    raw = spark.read.schema(TAXONOMY_SCHEMA).option("mode", "FAILFAST").json(path)
    nodes = raw.select(
        F.col("taxonomy.taxId").alias("tax_id"),
        F.coalesce("taxonomy.currentScientificName.name", F.lit("")).alias("name"),
        F.coalesce(F.upper("taxonomy.rank"), F.lit("")).alias("rank"),
        tidy_classification(F.col("taxonomy.classification")).alias("classification"),
        F.coalesce("taxonomy.parents", F.array().cast("array<bigint>")).alias("parent_ids"),
        F.coalesce("taxonomy.children", F.array().cast("array<bigint>")).alias("child_ids"),
        position().alias("line"),
    ).filter("tax_id IS NOT NULL")
    return last_wins(nodes, ["tax_id"], F.col("line")).drop("line")


def tidy_classification(classification: Column) -> Column:
    """Lower-case ranks; entries without name or id are left out."""
    complete = F.map_filter(classification, lambda _, v: v["name"].isNotNull() & v["id"].isNotNull())
    lowered = F.transform(
        F.map_entries(complete),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<name:string,id:bigint>>>"))
    return F.coalesce(F.map_from_entries(lowered), empty)
