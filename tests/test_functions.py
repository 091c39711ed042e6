"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from cladeledger.functions import accessions, checksums, filetypes, messages, names, space, text


def apply(spark, function, values, column_type="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, v {column_type}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v")).alias("r")).collect()]


def test_valid_binomial(spark):
    cases = {
        "Escherichia coli": True,
        "Escherichia sp.": False,
        "uncultured bacterium": False,
        "Clostridium niger-alba": True,
        "Bacillus subtilis": True,
        "Candidatus Liberibacter": False,
        "Pseudomonas affinis": False,
        "  Escherichia \t coli ": True,
        "Escherichia coli K12": False,
        "Ébcd efgh": False,
        "Abc strain": False,
        "Abc def-strain": False,
        "": False,
        None: False,
    }
    assert apply(spark, names.is_valid_binomial, cases) == list(cases.values())


def test_rejection_reason(spark):
    cases = {
        "Escherichia coli": "Valid",
        "Escherichia sp.": "Contains invalid characters (only letters, spaces, hyphens allowed)",
        "Escherichia sp": "Specific epithet too short (2 chars), need ≥3",
        "Escherichia species": "Contains unidentified marker: species",
        "Abc def-var": "Contains subspecies marker: var",
        "Abc strain": "Contains subspecies marker: strain",
        "Uncultured bacterium": "Contains generic term: bacterium",
        "Escherichia 2": "Contains numbers",
        "Escherichia": "Too few words (1), need exactly 2",
        "Abc def ghi": "Too many words (3), need exactly 2",
        "abc def": "Genus name must start with uppercase letter",
        "Ab-cd def": "Genus name must not contain hyphens",
        "ABc def": "Genus name must have lowercase letters after first",
        "A def": "Genus name must have lowercase letters after first",
        "Ab def": "Genus name too short (2 chars), need ≥3",
        "Abc Def": "Specific epithet must be all lowercase",
        "Abc ab-cd": "Specific epithet format invalid",
        "": "Empty or invalid input",
        None: "Empty or invalid input",
        "   ": "Contains invalid characters (only letters, spaces, hyphens allowed)",
    }
    assert apply(spark, names.rejection_reason, cases) == list(cases.values())


def test_reason_is_valid_exactly_for_valid_names(spark, sf):
    from cladeledger.workload.fixtures import derived
    from cladeledger.workspace import materialize

    rows = materialize(derived(spark, sf, "names"), "names")
    differ = (names.rejection_reason(F.col("name")) == names.VALID) != names.is_valid_binomial(F.col("name"))
    assert rows.filter(differ).isEmpty()


def test_accessions(spark):
    paths = ["test_output/2162/GCA_000302455.1.fna", "GCF_000001405.40_genomic.fna", "invalid_file.txt", "gca_000000001.2.x", ""]
    assert apply(spark, accessions.strict_accession, paths) == [
        "GCA_000302455.1", "GCF_000001405.40", None, "GCA_000000001.2", None,
    ]
    paths = ["/data/GCF_001267435.1/protein.faa", "/some/path/without/accession/file.fna", "gca_000000001.2"]
    assert apply(spark, accessions.loose_accession, paths) == ["GCF_001267435.1", None, None]


def test_extensions_and_simple_names(spark):
    assert apply(spark, accessions.file_extension, ["file.tar.gz", "file.genomic.fna", "file", "tar.gz", ".hidden", "A.TAR.GZ"]) == [
        ".tar.gz", ".fna", "", ".gz", "", ".TAR.GZ",
    ]
    assert apply(spark, accessions.simplified_name, ["GCA_000837045.1_ViralProj14067_genomic.fna", "unknown_file.fna", "gca_000837045.1_x.tar.gz"]) == [
        "GCA_000837045.1.fna", "unknown_file.fna", "gca_000837045.1.tar.gz",
    ]


def test_file_types(spark):
    cases = {
        "protein.faa": "protein",
        "cds_from_genomic.fna": "cds",
        "genomic.gff": "gff3",
        "genomic.gtf": "gtf",
        "genomic.gbff": "gbff",
        "sequence_report.jsonl": "seq-report",
        "rna_from_genomic.fna": "rna",
        "GCF_001267435.1_ASM126743v1_genomic.fna": "genome",
        "assembly_data_report.jsonl": None,
        "notes.txt": None,
    }
    assert apply(spark, filetypes.file_type, cases) == list(cases.values())
    assert apply(spark, lambda c: filetypes.file_type(c, ["genome"]), ["a.fna", "a.faa"]) == ["genome", None]


def test_output_names(spark):
    cases = {"protein.faa": ".faa", "cds_from_genomic.fna": ".cds", "genomic.gff3": ".gff", "genome.fa": ".fna", "genomic.gb": ".gbff", "x": ""}
    assert apply(spark, filetypes.output_extension, cases) == list(cases.values())
    path = "/data/GCF_001267435.1/GCF_001267435.1_ASM126743v1_genomic.fna"
    assert apply(spark, filetypes.standard_name, [path, "protein.faa"]) == ["GCF_001267435.1.fna", None]


def test_include_lists(spark):
    lists = [["genome", "protein"], ["gff3", "gtf"], [], ["none", "protein"], ["protein", "x", "protein"]]
    assert apply(spark, filetypes.include_extensions, lists, "array<string>") == [
        [".fa", ".faa", ".fasta", ".fna"], [".gff", ".gff3", ".gtf"], [".fa", ".fasta", ".fna"],
        [".fa", ".faa", ".fasta", ".fna"], [".faa"],
    ]
    wanted = [["genome", "protein"], ["gff3", "gtf"], ["genome"], ["genome"], ["protein"]]
    assert apply(spark, filetypes.normalized_include, lists, "array<string>") == wanted
    assert [filetypes.include_types(value) for value in lists] == wanted


DIGEST = "d41d8cd98f00b204e9800998ecf8427e"


@pytest.mark.parametrize(
    ("dialect", "line", "expected"),
    [
        ("strict", f"{DIGEST}  empty.txt", (DIGEST, "empty.txt")),
        ("strict", f" {DIGEST.upper()} *a b.txt ", (DIGEST, "a b.txt")),
        ("strict", "# comment", None),
        ("strict", f"{DIGEST[:31]}  x", None),
        ("flat", f"{DIGEST.upper()} *x.fna", (DIGEST.upper(), "x.fna")),
        ("flat", f"{DIGEST}  d\\x.fna", None),
        ("package", f"{DIGEST}  d\\x.fna", (DIGEST, "d/x.fna")),
        ("loose", "short  d/x.fna", ("short", "d/x.fna")),
        ("lower", f"{DIGEST.upper()}  x.fna", (DIGEST, "x.fna")),
        ("lenient", f"MD5 (d/x.fna) = {DIGEST}", (DIGEST, "d/x.fna")),
        ("lenient", f"MD5(x) = {DIGEST}", (DIGEST, "x")),
        ("lenient", "nothash  x.fna", None),
    ],
)
def test_checksum_lines(spark, dialect, line, expected):
    result = apply(spark, lambda c: checksums.parse_checksum_line(c, dialect), [line])[0]
    assert (tuple(result) if result else None) == expected


def test_paths(spark):
    assert apply(spark, checksums.split_relative_path, ["2162/GCA_000302455.1.fna", "GCA_000302455.1.fna"]) == [
        ("2162", "GCA_000302455.1.fna"), (".", "GCA_000302455.1.fna"),
    ]
    paths = ["a/b", "../x", "./a/../b", "/data/root", "/data/rooted/x", "/data/root/../root/y"]
    assert apply(spark, lambda c: checksums.resolve_inside(F.lit("/data/root"), c), paths) == [
        "/data/root/a/b", None, "/data/root/b", "/data/root", None, "/data/root/y",
    ]
    uris = ["hdfs://n:1/a/../b", "file:///a//b", "/a/b", "/a/./b/.."]
    assert apply(spark, checksums.normal_path, uris) == ["hdfs://n:1/b", "file:///a/b", "/a/b", "/a"]
    assert apply(spark, checksums.strip_package_prefix, ["./ncbi_dataset/data/A/x", "data/A/x", "//A/x", '"/data/x"', "a\\b"]) == [
        "A/x", "A/x", "A/x", "x", "a/b",
    ]


def test_directory_names(spark):
    values = ["Escherichia coli", "a'b  c", "___", "Ébène (x)", "a/b:c", "x" * 300]
    assert apply(spark, names.safe_directory_name, values) == [
        "Escherichia_coli", "a_b_c", "unknown_taxon", "Ébène_(x)", "a_b_c", "x" * 200,
    ]
    assert apply(spark, names.resume_directory_name, values)[:4] == ["Escherichia_coli", "a'b_c", "unknown_taxon", "Ébène_(x)"]
    assert apply(spark, names.ascii_file_name, values)[:4] == ["Escherichia_coli", "ab__c", "___", "bne_x"]


def test_secrets_are_hidden(spark):
    commands = [["datasets", "rehydrate", "--api-key", "abc123456789"], ["--api-key", "--api-key", "x"], ["--api-key=abc"], ["plain"]]
    assert apply(spark, messages.redacted_command, commands, "array<string>") == [
        ["datasets", "rehydrate", "--api-key", "***REDACTED***"], ["--api-key", "***REDACTED***", "x"],
        ["--api-key=***REDACTED***"], ["plain"],
    ]


def test_error_classes(spark):
    cases = {
        "Connection refused": "environment", "disk full": "filesystem", "gateway timeout": "transient",
        "taxon id not found": "data", "other": "processing",
    }
    assert apply(spark, messages.error_class, cases) == list(cases.values())


def test_levels(spark):
    assert apply(spark, lambda c: space.level_name(space.level_rank(c)), [0.5, 0.19, 0.09, 0.01], "double") == [
        "normal", "warning", "critical", "paused",
    ]
    many_bytes = F.lit(1 << 50)
    assert apply(spark, lambda c: space.level_rank(c, many_bytes), [0.01], "double") == [0]


def test_strip_and_suffix(spark):
    assert apply(spark, text.strip, ["\t a  \n", "\x1fb"]) == ["a", "b"]
    assert apply(spark, text.suffix, ["a.b/c", "a/b.tar.gz", ".x", "a."]) == ["", ".gz", "", ""]
