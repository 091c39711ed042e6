"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeledger import fixed_values as fixed
from cladeledger.functions import accessions, checksums, filetypes, messages, names, space, text
from cladeledger.operators import hierarchy, layout, reports
from cladeledger.workload.fixtures import derived, given
from cladeledger.workload.registry import query


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


# The words once more, for the SQL alone, so that a wrong word in the library shows.
_SUBSPECIES_MARKERS = [
    "subsp", "subspecies", "var", "variety", "forma", "f.", "str", "strain", "serovar", "serotype", "pv", "pathovar",
    "bv", "biovar",
]
_UNIDENTIFIED_MARKERS = [
    "sp", "species", "cf", "confer", "aff", "affinis",
]
_GENERIC_TERMS = [
    "archaeon", "archaea", "bacterium", "bacteria", "organism", "uncultured", "cultured", "unidentified",
    "identified", "unclassified", "classified", "candidatus", "endosymbiont", "symbiont", "endosymbiotic",
    "symbiotic", "group", "groups", "division", "cluster", "clusters", "clade", "clades", "complex", "isolate",
    "isolated", "clone", "cloned", "strain", "strains", "environmental", "metagenome", "metagenomic", "genomosp",
    "taxon", "taxa",
]
_ENVIRONMENT_PHRASES = [
    "command not found", "executable not found", "no such file or directory", "datasets not found",
    "version incompatible", "network unreachable", "connection refused", "dns resolution failed", "ssl certificate",
    "authentication failed", "unauthorized",
]
_FILESYSTEM_PHRASES = [
    "permission denied", "access denied", "disk full", "no space left", "read-only file system", "file exists",
    "directory not empty", "operation not permitted", "input/output error",
]
_TRANSIENT_PHRASES = [
    "timeout", "connection timeout", "read timeout", "rate limit", "too many requests", "service unavailable",
    "bad gateway", "gateway timeout", "temporary failure", "try again later", "server error", "internal server error",
]
_DATA_PHRASES = [
    "not found", "no data available", "invalid taxon", "no genomes", "empty result", "no assemblies",
    "taxon id not found", "invalid taxonomy", "no sequences found",
]
_RATE_LIMIT_PHRASES = [
    "rate limit", "too many requests", "429",
]
_RATE_LIMIT_EXCLUSIONS = [
    "no genome data", "is valid for", "please use a subspecies", "no annotations matching",
]
_RETRYABLE_PHRASES = [
    "timeout", "connection", "network", "unreachable", "temporary failure", "service unavailable", "rate limit",
]
_RETRYABLE_CODES = [
    "429", "502", "503", "504",
]


@query("fn_1_source_filter", "genomes", "select accession, tax_id, sequence_length from genomes where accession like 'GCF\\_%' escape '\\'")
def _(spark, sf):
    return hierarchy.filter_source(derived(spark, sf, "genomes"), "RefSeq").select("accession", "tax_id", "sequence_length")


_MARKS = _SUBSPECIES_MARKERS + _UNIDENTIFIED_MARKERS
_TIDY = "trim(regexp_replace(name, '\\s+', ' ', 'g'))"
_NO_MARK = (
    f"len(list_filter({_sql_list(_MARKS)}, lambda m: regexp_matches(n, '(?i)\\b' || replace(m, '.', '[.]') || '\\.?\\b'))) = 0"
    f" and len(list_filter({_sql_list(_GENERIC_TERMS)}, lambda m: regexp_matches(n, '(?i)\\b' || m || '\\b'))) = 0"
)
_VALID = (
    "coalesce(regexp_matches(n, '^[A-Za-z]+([ -][A-Za-z]+)*$') and len(string_split(n, ' ')) = 2"
    " and regexp_matches(split_part(n, ' ', 1), '^[A-Z][a-z]{2,}$')"
    f" and regexp_matches(split_part(n, ' ', 2), '^[a-z]{{3,}}(-[a-z]+)*$') and {_NO_MARK}, false)"
)


@query("fn_2_valid_binomial", "names", f"select p_partkey, {_VALID} as valid from t", f"t as (select p_partkey, {_TIDY} as n from names)")
def _(spark, sf):
    return derived(spark, sf, "names").select("p_partkey", names.is_valid_binomial(F.col("name")).alias("valid"))


def _first_marker(label: str, words) -> str:
    found = f"list_filter({_sql_list(words)}, lambda m: regexp_matches(n, '(?i)\\b' || replace(m, '.', '[.]') || '\\b'))"
    return f"when len({found}) > 0 then '{label}: ' || {found}[1] "


_REASON = (
    "case when name is null or name = '' then 'Empty or invalid input'"
    " when regexp_matches(n, '[0-9]') then 'Contains numbers'"
    " when not regexp_matches(n, '^[A-Za-z]+([ -][A-Za-z]+)*$')"
    " then 'Contains invalid characters (only letters, spaces, hyphens allowed)'"
    " when w < 2 then 'Too few words (' || w || '), need exactly 2'"
    " when w > 2 then 'Too many words (' || w || '), need exactly 2'"
    " when not regexp_matches(g, '^[A-Z][a-z]{2,}$') then case"
    "   when not regexp_matches(g, '^[A-Z]') then 'Genus name must start with uppercase letter'"
    "   when contains(g, '-') then 'Genus name must not contain hyphens'"
    "   when not regexp_matches(substr(g, 2), '^[a-z]+$') then 'Genus name must have lowercase letters after first'"
    "   when length(g) < 3 then 'Genus name too short (' || length(g) || ' chars), need ≥3'"
    "   else 'Genus name format invalid' end"
    " when not regexp_matches(e, '^[a-z]{3,}(-[a-z]+)*$') then case"
    "   when regexp_matches(e, '[A-Z]') then 'Specific epithet must be all lowercase'"
    "   when length(e) < 3 then 'Specific epithet too short (' || length(e) || ' chars), need ≥3'"
    "   else 'Specific epithet format invalid' end "
    + _first_marker("Contains subspecies marker", _SUBSPECIES_MARKERS)
    + _first_marker("Contains unidentified marker", _UNIDENTIFIED_MARKERS)
    + _first_marker("Contains generic term", _GENERIC_TERMS)
    + "else 'Valid' end"
)
_PARTS = (
    f"t as (select p_partkey, name, {_TIDY} as n from names),"
    " u as (select *, len(string_split(n, ' ')) as w, split_part(n, ' ', 1) as g, split_part(n, ' ', 2) as e from t)"
)


@query("fn_3_rejection_reason", "names", f"select p_partkey, {_REASON} as reason from u", _PARTS)
def _(spark, sf):
    return derived(spark, sf, "names").select("p_partkey", names.rejection_reason(F.col("name")).alias("reason"))


@query("fn_4_strict_accession", "paths", "select doc_id, upper(nullif(regexp_extract(path, '(?i)(GC[FA]_[0-9]{9}\\.[0-9]+)', 1), '')) as accession from paths")
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", accessions.strict_accession(F.col("path")).alias("accession"))


@query("fn_5_loose_accession", "paths", "select doc_id, nullif(regexp_extract(path, '(GC[AF]_[0-9]+\\.[0-9]+)', 1), '') as accession from paths")
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", accessions.loose_accession(F.col("path")).alias("accession"))


# By construction: the file name of each remainder and its include type.
_TYPE = (
    "case doc_id % 13 when 0 then 'protein' when 1 then 'cds' when 2 then 'rna' when 3 then 'gff3' when 4 then 'gff3'"
    " when 5 then 'gtf' when 6 then 'gbff' when 7 then 'seq-report' when 9 then 'genome' when 10 then 'genome' end"
)
_EXTENSION = (
    "case doc_id % 13 when 0 then '.faa' when 1 then '.cds' when 2 then '.rna.fna' when 3 then '.gff' when 4 then '.gff'"
    " when 5 then '.gtf' when 6 then '.gbff' when 7 then '.jsonl' when 8 then '.jsonl' when 9 then '.fna'"
    " when 10 then '.fna' when 11 then '.gz' else '' end"
)


@query("fn_6_file_type", "paths", f"select doc_id, {_TYPE} as include_type, case when {_TYPE} in ('genome', 'cds') then {_TYPE} end as allowed_type from paths")
def _(spark, sf):
    path = F.col("path")
    return derived(spark, sf, "paths").select(
        "doc_id", filetypes.file_type(path).alias("include_type"), filetypes.file_type(path, ["genome", "cds", "other"]).alias("allowed_type")
    )


@query("fn_7_output_extension", "paths", f"select doc_id, {_EXTENSION} as extension from paths")
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", filetypes.output_extension(F.col("path")).alias("extension"))


@query("fn_8_standard_name", "paths", f"select doc_id, acc || {_EXTENSION} as filename from paths")
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", filetypes.standard_name(F.col("path")).alias("filename"))


@query(
    "fn_9_expected_names", "paths",
    "select doc_id, t as include_type, acc || x as filename from paths, (values ('genome', '.fna', 0), ('protein', '.faa', 1), ('rna', '.rna.fna', 1), ('gff3', '.gff', 2)) v(t, x, k) where k = 0 or k <= doc_id % 3",
)
def _(spark, sf):
    wanted = F.when(F.col("doc_id") % 3 == 0, text.literal_array(["none"])).when(
        F.col("doc_id") % 3 == 1, text.literal_array(["genome", "protein", "genome", "rna", "what"])
    ).otherwise(text.literal_array(["gff3", "genome", "protein", "rna"]))
    rows = derived(spark, sf, "paths").select("doc_id", F.explode(filetypes.expected_names(F.col("acc"), wanted)).alias("e"))
    return rows.select("doc_id", "e.include_type", "e.filename")



# Include lists that follow the data: a word is in if the bit of its place is set in a number made of the text.
_WORDS = ["genome", "protein", "rna", "cds", "gff3", "gtf", "gbff", "seq-report", "bogus", "none", "GENOME", "rna"]
_ASKED_SQL = (
    "asked as (select doc_id, list_filter(['genome', 'protein', 'rna', 'cds', 'gff3', 'gtf', 'gbff', 'seq-report', 'bogus', 'none', 'GENOME', 'rna'],"
    " lambda w, i: (doc_id * 37 + n_chars * 11) // (1 << (i - 1)) % 2 = 1 and (n_chars % 3 > 0 or i in (2, 9, 11)) and (w <> 'none' or n_chars % 4 = 0)) as words from documents),"
    " known as (select doc_id, words, list_filter(['genome', 'protein', 'rna', 'cds', 'gff3', 'gtf', 'gbff', 'seq-report'], lambda w: list_contains(words, w)) as types from asked)"
)


def _asked(spark, sf):
    number = F.col("doc_id") * 37 + F.col("n_chars") * 11
    chosen = []
    for i, word in enumerate(_WORDS):
        taken = (F.floor(number / F.lit(1 << i)) % 2 == 1) & ((F.col("n_chars") % 3 > 0) | F.lit(i in (1, 8, 10)))
        chosen.append(F.when(taken & (F.lit(word != "none") | (F.col("n_chars") % 4 == 0)), word))
    return given(spark, sf, "documents").select("doc_id", F.array_compact(F.array(*chosen)).alias("words"))


_EXTENSIONS_OF = (
    "(values ('genome', ['.fna', '.fa', '.fasta']), ('protein', ['.faa']), ('rna', ['.fna', '.fa']), ('cds', ['.fna', '.fa']), ('gff3', ['.gff', '.gff3']),"
    " ('gtf', ['.gtf']), ('gbff', ['.gbff', '.gb']), ('seq-report', ['.jsonl'])) e(t, x)"
)
_NORMAL_SQL = "case when list_contains(words, 'none') or len(types) = 0 then ['genome'] else types end"


@query("fn_10_normalized_include", "", f"select doc_id, array_to_string(list_sort({_NORMAL_SQL}), ',') as include from known", _ASKED_SQL)
def _(spark, sf):
    return _asked(spark, sf).select("doc_id", F.array_join(F.array_sort(filetypes.normalized_include(F.col("words"))), ",").alias("include"))


@query(
    "fn_10_file_specs", "",
    f"select doc_id, t as include_type, array_to_string(x, ',') as extensions from (select doc_id, unnest({_NORMAL_SQL}) as t from known) join {_EXTENSIONS_OF} using (t)",
    _ASKED_SQL,
)
def _(spark, sf):
    rows = _asked(spark, sf).select("doc_id", F.explode(filetypes.file_specs(F.col("words"))).alias("s"))
    return rows.select("doc_id", "s.include_type", F.array_join("s.extensions", ",").alias("extensions"))


@query(
    "fn_11_include_extensions", "",
    "select doc_id, array_to_string(list_sort(list_distinct(flatten(list(x)))), ',') as extensions from (select doc_id, x from (select doc_id, unnest(types) as t from known)"
    f" join {_EXTENSIONS_OF} using (t) union all select doc_id, ['.fna', '.fa', '.fasta'] from known where len(types) = 0 or list_contains(words, 'none')) group by 1",
    _ASKED_SQL,
)
def _(spark, sf):
    return _asked(spark, sf).select("doc_id", F.array_join(filetypes.include_extensions(F.col("words")), ",").alias("extensions"))


@query(
    "fn_12_type_of_standard_name", "paths",
    f"select doc_id, case {_EXTENSION} when '.faa' then 'protein' when '.cds' then 'cds' when '.rna.fna' then 'rna' when '.gff' then 'gff3' when '.gtf' then 'gtf' when '.gbff' then 'gbff' when '.jsonl' then 'seq-report' else 'genome' end as include_type from paths",
)
def _(spark, sf):
    name = filetypes.standard_name(F.col("path"))
    return derived(spark, sf, "paths").select("doc_id", filetypes.type_of_standard_name(name).alias("include_type"))


@query(
    "fn_13_simplified_name", "paths",
    "select doc_id, case when a <> '' then a || x else b end as name from (select doc_id, regexp_extract(path, '[^/]*$') as b, regexp_extract(regexp_extract(path, '[^/]*$'), '(?i)(GC[FA]_[0-9]{9}\\.[0-9]+)', 1) as a, case when doc_id % 13 = 10 then '.fna' else '' end as x from paths)",
)
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", accessions.simplified_name(text.basename(F.col("path"))).alias("name"))


@query(
    "fn_14_file_extension", "paths",
    "select doc_id, case when ends_with(b, '.tar.gz') then '.tar.gz' else regexp_extract(b, '.(\\.[^.]+)$', 1) end as extension from (select doc_id, regexp_extract(path, '[^/]*$') as b from paths)",
)
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", accessions.file_extension(F.col("path")).alias("extension"))


_SAFE = (
    "coalesce(nullif(regexp_replace(case when length(s) > 200 then substr(s, 1, 200) else s end,"
    " case when length(s) > 200 then '_+$' else '^$' end, ''), ''), 'unknown_taxon')"
)


@query(
    "fn_15_safe_names", "",
    f"select doc_id, {_SAFE} as safe_name, md5(coalesce(nullif(r, ''), 'unknown_taxon')) as resume_name, substr(coalesce(nullif(a, ''), 'unknown'), 1, 100) as ascii_name, md5(p) as split_name from t",
    "t as (select doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\-.()]', '_', 'g'), '_+', '_', 'g'), '_') as s,"
    " trim(regexp_replace(regexp_replace(text, '[ <>:\"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '_') as r,"
    " regexp_replace(replace(text, ' ', '_'), '[^A-Za-z0-9\\-_.]', '', 'g') as a, replace(replace(text, ' ', '_'), '/', '_') as p from documents)",
)
def _(spark, sf):
    whole = F.col("text")
    return given(spark, sf, "documents").select(
        "doc_id",
        names.safe_directory_name(whole).alias("safe_name"),
        F.md5(names.resume_directory_name(whole)).alias("resume_name"),
        names.ascii_file_name(whole).alias("ascii_name"),
        F.md5(names.split_file_name(whole)).alias("split_name"),
    )


@query(
    "fn_16_strip_package_prefix", "paths",
    "select doc_id, case when doc_id % 7 = 6 then substr(path, 2) else regexp_extract(path, 'GC.*$') end as stripped from paths",
)
def _(spark, sf):
    return derived(spark, sf, "paths").select("doc_id", checksums.strip_package_prefix(F.col("path")).alias("stripped"))


_FORWARD = "replace(regexp_replace(r, '^\\*', ''), chr(92), '/')"
_DIALECT_ROWS = " union all ".join(
    [
        "select doc_id, 'strict' as dialect, lower(regexp_extract(s, '^([0-9a-fA-F]{32})\\s+\\*?(.+)$', 1)) as hash, trim(regexp_extract(s, '^([0-9a-fA-F]{32})\\s+\\*?(.+)$', 2)) as path from u where regexp_matches(s, '^([0-9a-fA-F]{32})\\s+\\*?(.+)$')",
        f"select doc_id, 'flat', h, {_FORWARD} from u where length(h) = 32 and not contains({_FORWARD}, '/')",
        f"select doc_id, 'package', h, {_FORWARD} from u where length(h) = 32",
        f"select doc_id, 'loose', h, {_FORWARD} from u where h <> ''",
        f"select doc_id, 'lower', lower(h), {_FORWARD} from u where h <> ''",
        "select doc_id, 'lenient', case when b <> '' then b else h end, case when b <> '' then regexp_extract(s, '^MD5 *\\((.+?)\\)', 1) else regexp_replace(r, '^\\*', '') end from u where b <> '' or regexp_matches(h, '^[0-9a-fA-F]{32}$')",
    ]
)


@query(
    "fn_17_checksum_line", "checksum_lines", _DIALECT_ROWS,
    "u as (select doc_id, trim(line) as s, regexp_extract(trim(line), '^(\\S+)\\s+(.+)$', 1) as h, regexp_extract(trim(line), '^(\\S+)\\s+(.+)$', 2) as r,"
    " regexp_extract(trim(line), '^MD5 *\\((.+?)\\) *= *([a-fA-F0-9]{32})$', 2) as b from checksum_lines where trim(line) <> '' and trim(line) not like '#%')",
)
def _(spark, sf):
    parsed = F.array(
        *[F.struct(F.lit(d).alias("dialect"), checksums.parse_checksum_line(F.col("line"), d).alias("e")) for d in checksums.DIALECTS]
    )
    rows = derived(spark, sf, "checksum_lines").select("doc_id", F.explode(parsed).alias("p")).filter("p.e IS NOT NULL")
    return rows.select("doc_id", "p.dialect", "p.e.hash", "p.e.path")


@query("fn_19_footprint", "genomes", "select accession, sequence_length / 1e9::double as size_gb, sequence_length / 1e9::double * 0.3::double as compressed_gb, sequence_length / 1e9::double * 1.05::double as fasta_gb, sequence_length / 1e9::double * 2.5::double as annotated_gb from genomes")
def _(spark, sf):
    return derived(spark, sf, "genomes").select("accession", space.footprint(F.col("sequence_length")).alias("f")).select("accession", "f.*")


@query("fn_20_content_md5", "", "select doc_id, md5(text) as hash from documents")
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))


@query(
    "fn_21_task_id", "files",
    "select doc_id, sha256('/data' || chr(0) || source || chr(0) || regexp_extract(file_path, '[^/]*$') || chr(0) || coalesce(expected_hash, '')) as task_id from files",
)
def _(spark, sf):
    parts = checksums.split_relative_path(F.col("file_path"))
    return derived(spark, sf, "files").select(
        "doc_id", checksums.task_id(F.lit("/data"), parts["directory"], parts["name"], F.col("expected_hash")).alias("task_id")
    )


@query(
    "fn_22_split_relative_path", "paths",
    "select doc_id, case when doc_id % 4 = 0 then '.' else regexp_replace(path, '/[^/]*$', '') end as directory, regexp_extract(path, '[^/]*$') as name from paths",
)
def _(spark, sf):
    path = F.when(F.col("doc_id") % 4 == 0, text.basename(F.col("path"))).otherwise(F.col("path"))
    return derived(spark, sf, "paths").select("doc_id", checksums.split_relative_path(path).alias("p")).select("doc_id", "p.directory", "p.name")


_CONTAINED = (
    "case doc_id % 6 when 0 then '/data/root/' || source || '/x.fna' when 1 then '/data/root/x.fna'"
    " when 2 then null when 3 then '/data/root/y' when 4 then null else '/data/root' end"
)


@query("fn_23_resolve_inside", "", f"select doc_id, {_CONTAINED} as resolved from documents")
def _(spark, sf):
    path = F.expr(
        "case doc_id % 6 when 0 then concat(source, '/x.fna') when 1 then concat('./', source, '/../x.fna')"
        " when 2 then concat('../rooted/', source) when 3 then '/data/./root//y' when 4 then '/data/root/../../etc' else '.' end"
    )
    return given(spark, sf, "documents").select("doc_id", checksums.resolve_inside(F.lit("/data/root"), path).alias("resolved"))


@query(
    "fn_24_display_path", "files",
    "select doc_id, case when doc_id % 3 = 0 then 'as/written' else file_path end as shown from files",
)
def _(spark, sf):
    absolute = F.concat(F.when(F.col("doc_id") % 3 == 0, "/other/").otherwise("/data/root/"), "file_path")
    return derived(spark, sf, "files").select(
        "doc_id", checksums.display_path(F.lit("/data/root"), absolute, F.lit("as/written")).alias("shown")
    )


@query(
    "fn_25_file_state", "files",
    "select doc_id, case when computed_hash is null then 'missing' when doc_id % 23 = 2 then 'error' when computed_hash = expected_hash then 'pass' else 'fail' end as status from files",
)
def _(spark, sf):
    error = F.when((F.col("doc_id") % 23 == 2), F.lit("I/O error: x"))
    state = checksums.file_state(F.col("expected_hash"), F.col("computed_hash"), F.col("computed_hash").isNotNull(), error)
    return derived(spark, sf, "files").select("doc_id", state.alias("status"))


_M = "lower(message)"
_BY_MESSAGE = (
    f"case when {_any(_M, _ENVIRONMENT_PHRASES)} then 'environment' when {_any(_M, _FILESYSTEM_PHRASES)} then 'filesystem'"
    f" when {_any(_M, _TRANSIENT_PHRASES)} then 'transient' when {_any(_M, _DATA_PHRASES)} then 'data' else 'processing' end"
)
ERROR_CLASS_SQL = (
    "case when exception_type in ('FileNotFoundError', 'PermissionError', 'OSError') then case"
    f" when {_any(_M, ['permission', 'access'])} then 'filesystem' when contains({_M}, 'not found') and contains({_M}, 'datasets') then 'environment'"
    f" when {_any(_M, ['space', 'disk'])} then 'filesystem' else 'processing' end"
    " when exception_type in ('ConnectionError', 'TimeoutError', 'URLError') then 'transient'"
    f" when exception_type in ('ValueError', 'KeyError', 'IndexError') then 'data' else {_BY_MESSAGE} end"
)


@query("fn_26_error_class", "errors", f"select event_id, {_BY_MESSAGE} as by_message, {ERROR_CLASS_SQL} as error_type from errors")
def _(spark, sf):
    message = F.col("message")
    return derived(spark, sf, "errors").select(
        "event_id", messages.error_class(message).alias("by_message"), messages.error_class(message, F.col("exception_type")).alias("error_type")
    )


@query("fn_27_error_flags", "errors", f"select event_id, {ERROR_CLASS_SQL} in ('environment', 'filesystem') as is_fatal, {ERROR_CLASS_SQL} = 'transient' as should_retry from errors")
def _(spark, sf):
    kind = messages.error_class(F.col("message"), F.col("exception_type"))
    return derived(spark, sf, "errors").select("event_id", messages.is_fatal(kind).alias("is_fatal"), messages.is_retryable(kind).alias("should_retry"))


@query(
    "fn_28_message_predicates", "errors",
    f"select event_id, {_any(_M, _RATE_LIMIT_PHRASES)} and not {_any(_M, _RATE_LIMIT_EXCLUSIONS)} as rate_limit,"
    f" event_id % 5 < 3 and {_any(_M, _RETRYABLE_PHRASES + _RETRYABLE_CODES)} as retry from errors",
)
def _(spark, sf):
    message = F.col("message")
    return derived(spark, sf, "errors").select(
        "event_id", messages.is_rate_limit(message).alias("rate_limit"),
        messages.is_retryable_message(message, F.col("event_id") % 5, 3).alias("retry"),
    )


_GIB = "1073741824::bigint"
_LEVEL = (
    f"case when f < 0.05::double and b < 1 * {_GIB} then 'paused' when f < 0.10::double and b < 5 * {_GIB} then 'critical'"
    f" when f < 0.20::double and b < 10 * {_GIB} then 'warning' else 'normal' end"
)


@query(
    "fn_29_space_level", "metrics", f"select seq, {_LEVEL} as level from t",
    "t as (select seq, least(free_permille / 1000::double, ((free_permille * 7) % 400) / 1000::double) as f,"
    f" least(free_permille * 30000000, (seq % 13) * {_GIB}) as b from metrics)",
)
def _(spark, sf):
    permille = F.col("free_permille")
    level = space.two_volume_level(
        permille / F.lit(1000.0), permille * 30000000, (permille * 7) % 400 / F.lit(1000.0), (F.col("seq") % 13) * fixed.LEVEL_BYTES["paused"]
    )
    return derived(spark, sf, "metrics").select("seq", level.alias("level"))


_H = "***REDACTED***"


@query(
    "fn_30_redacted_command", "",
    f"select event_id, case event_id % 5 when 0 then 'datasets --api-key {_H} download' when 1 then 'datasets --api-key={_H} x'"
    f" when 2 then 'datasets download' when 3 then '--api-key {_H} tail' else 'x --api-key' end as command from events",
)
def _(spark, sf):
    command = F.expr(
        "case event_id % 5 when 0 then array('datasets', '--api-key', concat('k', event_id), 'download')"
        " when 1 then array('datasets', concat('--api-key=', event_id), 'x') when 2 then array('datasets', 'download')"
        " when 3 then array('--api-key', '--api-key', 'tail') else array('x', '--api-key') end"
    )
    return given(spark, sf, "events").select("event_id", F.array_join(messages.redacted_command(command), " ").alias("command"))


@query("fn_31_numeric_id", "", "select p_partkey, p_partkey % 3 = 0 as numeric from part")
def _(spark, sf):
    taxon = F.expr("case p_partkey % 3 when 0 then concat(' ', p_partkey, ' ') when 1 then concat(p_partkey, 'x') else p_name end")
    return given(spark, sf, "part").select("p_partkey", names.is_numeric_id(taxon).alias("numeric"))


@query(
    "fn_32_package_state", "",
    "select cast(c_custkey as varchar) as package, case c_custkey % 5 when 0 then 'ready' when 1 then 'ready' when 2 then 'empty_fetch_manifest' when 3 then 'missing_fetch_manifest' else 'malformed_package' end as status,"
    " case c_custkey % 5 when 0 then '' when 1 then '' when 2 then 'package_empty_fetch_manifest' when 3 then 'package_missing_fetch_manifest' else 'malformed_package' end as error_type from customer",
)
def _(spark, sf):
    listing = F.expr(
        "case c_custkey % 5 when 0 then array(named_struct('p', 'ncbi_dataset/fetch.txt', 's', 10L), named_struct('p', 'fetch.txt', 's', 0L))"
        " when 1 then array(named_struct('p', 'fetch.txt', 's', 5L)) when 2 then array(named_struct('p', 'ncbi_dataset/fetch.txt', 's', 0L))"
        " when 3 then array(named_struct('p', 'ncbi_dataset/data/x', 's', 1L)) else array(named_struct('p', 'README.md', 's', 1L)) end"
    )
    files = given(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("package"), F.explode(listing).alias("f"))
    return layout.package_state(files.select("package", F.col("f.p").alias("rel_path"), F.col("f.s").alias("size")))


@query(
    "fn_33_unmapped_entry", "paths",
    "select doc_id, case when doc_id % 13 in (0, 1, 2, 3, 4, 5, 6, 9, 10) or doc_id % 4 = 0 then regexp_extract(path, '[^/]*$') end as name from paths",
)
def _(spark, sf):
    exists = F.col("doc_id") % 4 == 0
    return derived(spark, sf, "paths").select("doc_id", checksums.unmapped_entry_name(F.col("path"), exists).alias("name"))


@query(
    "fn_34_space_requirement", "genomes",
    "select accession, required as required_bytes, m as required_with_margin, tf >= m as temp_sufficient, o >= m as output_sufficient,"
    " case when s then least(tf, o) >= m else tf >= m and o >= m end as overall_sufficient from u",
    "t as (select accession, cast(trunc(sequence_length * ((1 + sequence_length % 4) * 2.0::double)) as bigint) as required, cast(200000000 as bigint) as tf, (sequence_length % 7) * 60000000 as o, sequence_length % 2 = 0 as s from genomes),"
    " u as (select *, cast(trunc(required * 1.2::double) as bigint) as m from t)",
)
def _(spark, sf):
    size = F.col("sequence_length")
    need = space.space_requirement(size, 1 + size % 4, F.lit(200000000), (size % 7) * 60000000, size % 2 == 0)
    return derived(spark, sf, "genomes").select("accession", need.alias("n")).select("accession", "n.*")


@query(
    "ag_7_name_statistics", "names",
    f"select count(*) as total, count(case when {_VALID} then 1 end) as valid, count(*) - count(case when {_VALID} then 1 end) as invalid, round(count(case when {_VALID} then 1 end) / count(*)::double * 100, 2) as valid_rate from t",
    f"t as (select p_partkey, {_TIDY} as n from names)",
)
def _(spark, sf):
    return reports.name_statistics(derived(spark, sf, "names"))


@query(
    "pl_7_validate_names", "names", f"select {_VALID} as valid, {_REASON} as reason, count(*) as n_names from u group by 1, 2", _PARTS,
)
def _(spark, sf):
    from cladeledger.plans.audit import validate_names

    rows, _totals = validate_names(derived(spark, sf, "names"))
    return rows.groupBy("valid", "reason").agg(F.count("*").alias("n_names"))


@query(
    "ag_10_error_counts", "errors",
    "select error_type, count(*) as n_errors, count(*) / (sum(count(*)) over ())::double * 100 as percentage, error_type in ('environment', 'filesystem') as is_fatal, error_type = 'transient' as should_retry from t group by error_type",
    f"t as (select {ERROR_CLASS_SQL} as error_type from errors)",
)
def _(spark, sf):
    return reports.error_counts(classified_errors(spark, sf))


def classified_errors(spark, sf):
    kind = messages.error_class(F.col("message"), F.col("exception_type"))
    return derived(spark, sf, "errors").withColumn("error_type", kind)


_TOP = (
    "select error_type, taxon, message, place, n_more from (select error_type, taxon, message,"
    " row_number() over (partition by error_type order by event_id) as place,"
    " greatest(count(*) over (partition by error_type) - 10, 0) as n_more from t) where place <= 10"
)


@query("wn_4_top_failures", "errors", _TOP, f"t as (select *, {ERROR_CLASS_SQL} as error_type from errors)")
def _(spark, sf):
    return reports.top_failures(classified_errors(spark, sf), [F.col("event_id")]).select("error_type", "taxon", "message", "place", "n_more")


@query("pl_8_error_report", "errors", _TOP, f"t as (select *, {ERROR_CLASS_SQL} as error_type from errors)")
def _(spark, sf):
    from cladeledger.plans.audit import error_report

    _counts, top = error_report(classified_errors(spark, sf), [F.col("event_id")])
    return top.select("error_type", "taxon", "message", "place", "n_more")


@query(
    "pl_8_error_totals", "errors",
    "select error_type, count(*) as n_errors, count(*) / (sum(count(*)) over ())::double * 100 as percentage, error_type in ('environment', 'filesystem') as is_fatal, error_type = 'transient' as should_retry from t group by error_type",
    f"t as (select {ERROR_CLASS_SQL} as error_type from errors)",
)
def _(spark, sf):
    from cladeledger.plans.audit import error_report

    counts, _top = error_report(classified_errors(spark, sf), [F.col("event_id")])
    return counts
