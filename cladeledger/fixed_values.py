"""Fixed values of the data formats: results depend on these exact words, names and limits."""

# Include types and the file extensions that belong to each.
INCLUDE_EXTENSIONS = {
    "genome": [".fna", ".fa", ".fasta"],
    "protein": [".faa"],
    "rna": [".fna", ".fa"],
    "cds": [".fna", ".fa"],
    "gff3": [".gff", ".gff3"],
    "gtf": [".gtf"],
    "gbff": [".gbff", ".gb"],
    "seq-report": [".jsonl"],
}

# The one output extension of each include type.
OUTPUT_EXTENSIONS = {
    "genome": ".fna",
    "protein": ".faa",
    "rna": ".rna.fna",
    "cds": ".cds",
    "gff3": ".gff",
    "gtf": ".gtf",
    "gbff": ".gbff",
    "seq-report": ".jsonl",
}

# Extension spellings that are folded into one.
EXTENSION_SPELLINGS = {".fa": ".fna", ".fasta": ".fna", ".gff3": ".gff", ".gb": ".gbff"}

# Report files of a package that are never data files.
METADATA_NAMES = ["assembly_data_report.jsonl", "dataset_catalog.json", "assembly_stats.txt"]

# Extensions of data files among checksum entries without a rename mapping.
UNMAPPED_DATA_EXTENSIONS = [
    ".fna", ".fa", ".fasta", ".faa", ".gbff", ".gb", ".gff", ".gff3", ".gtf", ".cds",
]

# Path prefixes of a package, in the order they are tried.
PACKAGE_PREFIXES = [
    "./ncbi_dataset/data/",
    "ncbi_dataset/data/",
    "./data/",
    "data/",
    "./ncbi_dataset/",
    "ncbi_dataset/",
    "./",
    "/data/",
    "/ncbi_dataset/data/",
    "/ncbi_dataset/",
]

# Ranks from the widest to the narrowest.
RANKS = ["SUPERKINGDOM", "KINGDOM", "PHYLUM", "CLASS", "ORDER", "FAMILY", "GENUS", "SPECIES"]

# Words that make a name a subspecies or variety.
SUBSPECIES_MARKERS = [
    "subsp", "subspecies", "var", "variety", "forma", "f.", "str", "strain",
    "serovar", "serotype", "pv", "pathovar", "bv", "biovar",
]

# Words that mark an unidentified species.
UNIDENTIFIED_MARKERS = ["sp", "species", "cf", "confer", "aff", "affinis"]

# Words that are not part of a proper species name.
GENERIC_TERMS = [
    "archaeon", "archaea", "bacterium", "bacteria", "organism",
    "uncultured", "cultured", "unidentified", "identified", "unclassified", "classified",
    "candidatus",
    "endosymbiont", "symbiont", "endosymbiotic", "symbiotic",
    "group", "groups", "division", "cluster", "clusters", "clade", "clades", "complex",
    "isolate", "isolated", "clone", "cloned", "strain", "strains",
    "environmental", "metagenome", "metagenomic", "genomosp", "taxon", "taxa",
]

# Phrases of an error message, by error class, in the order the classes are tried.
ENVIRONMENT_PHRASES = [
    "command not found", "executable not found", "no such file or directory",
    "datasets not found", "version incompatible", "network unreachable",
    "connection refused", "dns resolution failed", "ssl certificate",
    "authentication failed", "unauthorized",
]
FILESYSTEM_PHRASES = [
    "permission denied", "access denied", "disk full", "no space left",
    "read-only file system", "file exists", "directory not empty",
    "operation not permitted", "input/output error",
]
TRANSIENT_PHRASES = [
    "timeout", "connection timeout", "read timeout", "rate limit",
    "too many requests", "service unavailable", "bad gateway",
    "gateway timeout", "temporary failure", "try again later",
    "server error", "internal server error",
]
DATA_PHRASES = [
    "not found", "no data available", "invalid taxon", "no genomes",
    "empty result", "no assemblies", "taxon id not found",
    "invalid taxonomy", "no sequences found",
]

# Exception type names that decide the class before the message is read.
FILE_EXCEPTIONS = ["FileNotFoundError", "PermissionError", "OSError"]
NETWORK_EXCEPTIONS = ["ConnectionError", "TimeoutError", "URLError"]
VALUE_EXCEPTIONS = ["ValueError", "KeyError", "IndexError"]

# Rate-limit phrases, what rules them out, and retryable phrases and codes.
RATE_LIMIT_PHRASES = ["rate limit", "too many requests", "429"]
RATE_LIMIT_EXCLUSIONS = [
    "no genome data", "is valid for", "please use a subspecies", "no annotations matching",
]
RETRYABLE_PHRASES = [
    "timeout", "connection", "network", "unreachable",
    "temporary failure", "service unavailable", "rate limit",
]
RETRYABLE_CODES = ["429", "502", "503", "504"]

# The secret flag of a command line and the text that hides its value.
SECRET_FLAG = "--api-key"
REDACTED = "***REDACTED***"

# File states after verification, and the failing ones.
PASS, FAIL, MISSING, ERROR = "pass", "fail", "missing", "error"
FAILING_STATES = [FAIL, MISSING, ERROR]

# Repair task states.
TASK_STATES = [
    "PENDING", "SKIPPED_NO_ACCESSION", "DOWNLOAD_QUEUED", "DOWNLOADING", "DOWNLOADED",
    "ORGANIZING", "ORGANIZED", "VERIFYING", "FIXED", "STILL_FAILED",
    "FAILED_RETRYABLE", "FAILED_FATAL",
]
SKIPPED_TEXT = "No accession id found for failed file"
STALE_FIX_TEXT = "Previously fixed target no longer matches expected MD5"
RETRY_TEXT = "Retry requested by --md5sum-auto-fix-retry-failed"

# Space levels, worst last, with the free fraction and free bytes each needs.
LEVELS = ["normal", "warning", "critical", "paused"]
LEVEL_FRACTIONS = {"warning": 0.20, "critical": 0.10, "paused": 0.05}
LEVEL_BYTES = {"warning": 10 * 1024**3, "critical": 5 * 1024**3, "paused": 1024**3}
RECOVERY_MARGIN = 0.02

# Disk use per gigabase, and the peak and safety factors of a download.
FOOTPRINT_COMPRESSED, FOOTPRINT_FASTA, FOOTPRINT_ANNOTATED = 0.3, 1.05, 2.5
PEAK_FACTOR, SAFETY_FACTOR = 2.0, 1.2
BASES_PER_GB = 1_000_000_000

# Manifest document version and default checksum source.
MANIFEST_SCHEMA_VERSION = 1
PACKAGE_CHECKSUM_SOURCE = "ncbi_datasets_package"
LEGACY_CHECKSUM_SOURCE = "legacy_md5sum_import"
CHECKSUM_LIST_NAME = "md5sum.txt"
MANIFEST_NAME = ".accession_manifest.json"
LIST_BACKUP_NAME = "md5sum.txt.pre_manifest_migration.bak"
DEFAULT_BATCH_SIZE = 100
TOP_FAILURES = 10

# The classes of errors.
ERROR_CLASSES = ["environment", "filesystem", "transient", "data", "processing"]
