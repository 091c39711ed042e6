"""Queries of sources, sinks, streams and whole plans: data goes out to files and comes back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cladeledger import fixed_values as fixed
from cladeledger.functions import messages
from cladeledger.functions.checksums import parse_checksum_line
from cladeledger.operators import hierarchy, packing, repair, task_machine
from cladeledger.operators.integrity import count_states, failing
from cladeledger.operators.resume import progress_state
from cladeledger.ordering import with_row_number
from cladeledger.plans import audit, split
from cladeledger.sinks import checksums as checksum_sinks
from cladeledger.sinks import documents as document_sinks
from cladeledger.sinks import splits
from cladeledger.sinks.lines import write_lines
from cladeledger.sinks.reports import write_run_summary
from cladeledger.sinks.single_file import read_text_file, write_lines_file
from cladeledger.sources import archives, catalogue, documents, inventory, lines
from cladeledger.streaming import commits
from cladeledger.streaming import levels as level_streams
from cladeledger.streaming import tasks as task_streams
from cladeledger.streaming.state import stream_of
from cladeledger.workload import operators as ops
from cladeledger.workload import trees
from cladeledger.workload.fixtures import derived, given
from cladeledger.workload.functions import ERROR_CLASS_SQL, classified_errors
from cladeledger.workload.registry import query
from cladeledger.workspace import materialize, new_path


def in_order(order: str, rows: str, per: str = "") -> str:
    """SQL that numbers the lines of ``rows``, which has the columns of ``order``."""
    window = f"partition by {per} order by {order}" if per else f"order by {order}"
    return f"select {per + ', ' if per else ''}row_number() over ({window}) as no, line from ({rows})"


# Sources -------------------------------------------------------------------------------------------


@query("src_1_catalogue", "genomes", "select accession, organism_name, tax_id, sequence_length from genomes where sequence_length % 29 <> 0")
def _(spark, sf):
    path = new_path(spark, "catalogue")
    length = F.when(F.col("sequence_length") % 29 != 0, F.concat(F.lit(" "), F.col("sequence_length").cast("string"), F.lit(" ")))
    columns = catalogue.CATALOGUE_COLUMNS
    table = derived(spark, sf, "genomes").select(
        F.lit("x").alias("Other"),
        F.col("accession").alias(columns["accession"]),
        F.col("organism_name").alias(columns["organism_name"]),
        F.col("tax_id").alias(columns["tax_id"]),
        length.alias(columns["sequence_length"]),
    )
    table.write.option("sep", "\t").option("header", True).csv(path)
    return catalogue.read_catalogue(spark, path)


@query(
    "src_2_taxonomy", "taxonomy",
    "select t.tax_id, t.name, t.rnk as rank, case when t.rnk = 'PHYLUM' then 0 else 1 end as n_parents, case when p.rnk = 'GENUS' then p.name end as genus, case when p.rnk = 'GENUS' then p.tax_id end as genus_id from taxonomy t left join taxonomy p on p.tax_id = t.parent",
)
def _(spark, sf):
    flat = derived(spark, sf, "taxonomy")
    genus = flat.filter("rnk = 'GENUS'").select(F.col("tax_id").alias("parent"), F.col("name").alias("genus"))
    copies = flat.join(genus, "parent", "left").withColumn("copy", F.explode(F.expr("IF(tax_id % 7 = 0, array(0, 1), array(1))")))
    name = F.when(F.col("copy") == 0, "outdated").otherwise(F.col("name"))
    good = F.struct(F.col("genus").alias("name"), F.col("parent").alias("id"))
    half = F.struct(F.lit(None).cast("string").alias("name"), F.col("parent").alias("id"))
    node = F.struct(
        F.col("tax_id").alias("taxId"),
        F.lower("rnk").alias("rank"),
        F.struct(name.alias("name")).alias("currentScientificName"),
        F.when(F.col("genus").isNotNull(), F.create_map(F.lit("Genus"), good, F.lit("family"), half)).alias("classification"),
        F.when(F.col("parent").isNotNull(), F.array("parent")).alias("parents"),
    )
    text = copies.select("copy", "tax_id", F.to_json(F.struct(node.alias("taxonomy"))).alias("line"))
    path = new_path(spark, "taxonomy")
    write_lines(text, path, ["copy", "tax_id"])
    found = F.col("classification")["genus"]
    return catalogue.read_taxonomy(spark, path).select(
        "tax_id", "name", "rank", F.size("parent_ids").alias("n_parents"), found["name"].alias("genus"), found["id"].alias("genus_id")
    )


@query("src_3_accession_list", "requested", "select 'GCA_' || item || '.1' as accession, count(*) as copies from requested group by 1")
def _(spark, sf):
    path = new_path(spark, "accessions")
    item = F.concat(F.lit(" GCA_"), F.col("item").cast("string"), F.lit(".1\t"))
    write_lines(derived(spark, sf, "requested").withColumn("line", item), path, ["line_number", "item"])
    return lines.read_accessions(spark, path).select("accession", "copies")


@query(
    "src_4_taxon_list", "",
    "select case c_custkey % 6 when 0 then c_name when 1 then cast(c_custkey as varchar) else c_name end as taxon, count(*) as n from customer where c_custkey % 6 in (0, 1, 5) group by 1",
)
def _(spark, sf):
    path = new_path(spark, "taxa")
    text = F.expr(
        "case c_custkey % 6 when 0 then c_name when 1 then concat(c_name, '\\t', c_custkey) when 2 then '# note'"
        " when 3 then '  ' when 4 then concat(c_name, '\\t \\tx') else concat(' ', c_name, ' ') end"
    )
    write_lines(given(spark, sf, "customer").select("c_custkey", text.alias("line")), path, ["c_custkey"])
    return lines.read_taxa(spark, path).groupBy("taxon").agg(F.count("*").alias("n"))


def checksum_list(spark, sf):
    path = new_path(spark, "lists")
    write_lines(derived(spark, sf, "checksum_lines"), path, ["doc_id"])
    return path


_STRICT_SQL = "regexp_matches(trim(line), '^[0-9a-fA-F]{32}\\s+\\*?.+$')"


@query(
    "src_5_checksum_list", "checksum_lines",
    f"select lower(substr(trim(line), 1, 32)) as expected_hash, regexp_extract(trim(line), '^\\S+\\s+\\*?(.+)$', 1) as file_path, '/' || regexp_extract(trim(line), '^\\S+\\s+\\*?(.+)$', 1) as below_list from checksum_lines where {_STRICT_SQL}",
)
def _(spark, sf):
    path = checksum_list(spark, sf)
    below = F.regexp_replace("abs_path", "^.*/lists-[0-9a-f]+", "")
    return lines.read_checksums(spark, path).select("expected_hash", "file_path", below.alias("below_list"))


@query(
    "src_6_checksum_list_lenient", "checksum_lines",
    "select case when doc_id % 9 = 2 then right(line, 32) else substr(trim(line), 1, 32) end as expected_hash, case when doc_id % 9 = 2 then 'dir/a' || doc_id || '.faa' else regexp_extract(trim(line), '^\\S+\\s+\\*?(.+)$', 1) end as file_path from checksum_lines where doc_id % 9 in (0, 1, 2, 6, 8)",
)
def _(spark, sf):
    return lines.read_checksums_lenient(spark, checksum_list(spark, sf)).select("expected_hash", "file_path")


@query("src_7_package_checksums", "paths", "select 'package' || cast(floor(doc_id / 100) as bigint) || '.zip' as package, case when cast(floor(doc_id / 100) as bigint) % 2 = 1 then 'md5sum.txt' else 'a/md5sum.txt' end as member, md5(path) as expected_hash, path as file_path from paths")
def _(spark, sf):
    found = inventory.list_tree(spark, trees.packages(spark, sf))
    entries = archives.read_package_checksums(found.select("path"))
    return entries.select(F.substring_index("package", "/", -1).alias("package"), "member", "expected_hash", "file_path")


@query("src_7_member_lines", "paths", "select 'package' || cast(floor(doc_id / 100) as bigint) || '.zip' as archive, case when cast(floor(doc_id / 100) as bigint) % 2 = 1 then 'md5sum.txt' else 'a/md5sum.txt' end as member, count(*) as n_lines, count(distinct path) as n_paths from paths group by 1, 2")
def _(spark, sf):
    """Members of archives as a table, their lines read by as many tasks as there are members."""
    found = inventory.list_tree(spark, trees.packages(spark, sf))
    members = archives.list_members(found.filter(F.endswith("name", F.lit(".zip"))))
    wanted = members.filter(F.col("member") == F.when(F.regexp_extract("archive", "package([0-9]+)", 1).cast("int") % 2 == 1, "md5sum.txt").otherwise("a/md5sum.txt"))
    entry = parse_checksum_line(F.col("value"), "package")
    lines_found = archives.member_lines(wanted).withColumn("entry", entry).filter("entry IS NOT NULL")
    return lines_found.groupBy(F.substring_index("archive", "/", -1).alias("archive"), "member").agg(
        F.count("*").alias("n_lines"), F.count_distinct("entry.path").alias("n_paths")
    )


@query("src_13_one_flat_folder", "paths", "select count(*) as n_files, min(doc_id || '.fna') as first_name, max(doc_id || '.fna') as last_name from paths")
def _(spark, sf):
    """A folder with a file per row, listed by all tasks."""
    found = inventory.list_tree(spark, trees.flat_folder(spark, sf), shared_from=100)
    return found.agg(F.count("*").alias("n_files"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def manifest_rows(spark, sf):
    name = F.substring_index("filename", "/", -1)
    return derived(spark, sf, "manifest").select(
        F.regexp_replace(name, "[.]fna$", "").alias("accession"), F.lit("genome").alias("include_type"),
        "filename", "expected_md5", F.lit(fixed.PACKAGE_CHECKSUM_SOURCE).alias("checksum_source"),
    )


_MANIFEST_SQL = "select filename, replace(substr(filename, strpos(filename, '/') + 1), '.fna', '') as accession, expected_md5, '2024-01-01T00:00:00Z' as committed_at from manifest"


@query("src_8_manifest_documents", "manifest", _MANIFEST_SQL)
def _(spark, sf):
    path = new_path(spark, "manifest")
    document_sinks.write_manifest(manifest_rows(spark, sf), path, "2024-01-01T00:00:00Z", documents=5)
    return documents.read_manifest(spark, path).select("filename", "accession", "expected_md5", "committed_at")


@query("snk_7_manifest_document", "manifest", _MANIFEST_SQL)
def _(spark, sf):
    path = new_path(spark, "manifest")
    document_sinks.write_manifest(manifest_rows(spark, sf), path, "2024-01-01T00:00:00Z", documents=1)
    return documents.read_manifest(spark, path).select("filename", "accession", "expected_md5", "committed_at")


@query("snk_7_whole_document", "manifest", _MANIFEST_SQL)
def _(spark, sf):
    """One file that all tasks write, replaced once, read in as many tasks as it is long."""
    path = f"{new_path(spark, 'manifest')}/manifest.json"
    rows = manifest_rows(spark, sf)
    document_sinks.write_manifest_document(rows.limit(0), path, "")
    document_sinks.write_manifest_document(rows, path, "2024-01-01T00:00:00Z")
    found = documents.read_document_entries(spark, path, documents.ARTIFACT_FIELDS)
    return found.select("filename", "accession", "expected_md5", "committed_at")


@query("snk_7_manifest_rows", "manifest", _MANIFEST_SQL)
def _(spark, sf):
    path = new_path(spark, "manifest")
    document_sinks.write_manifest_rows(manifest_rows(spark, sf), path, "2024-01-01T00:00:00Z")
    return documents.read_manifest_rows(spark, path).select("filename", "accession", "expected_md5", "committed_at")


@query("src_9_progress_state", "", f"select cast(item as varchar) as item, state from ({ops._PROGRESS_STATE})", ops._PROGRESS)
def _(spark, sf):
    path = new_path(spark, "progress")
    states = progress_state(ops.progress_events(spark, sf), F.col("seq")).withColumn("item", F.col("item").cast("string"))
    document_sinks.write_progress(states, path, 10.0, 20.0, documents=4)
    return documents.read_progress(spark, path)


@query("snk_8_whole_document", "", f"select cast(item as varchar) as item, state from ({ops._PROGRESS_STATE})", ops._PROGRESS)
def _(spark, sf):
    path = f"{new_path(spark, 'progress')}/progress.json"
    states = progress_state(ops.progress_events(spark, sf), F.col("seq")).withColumn("item", F.col("item").cast("string"))
    document_sinks.write_progress_document(states, path, 10.0, 20.0)
    return documents.read_progress(spark, path)


_TASK_SQL = f"select {ops.TASK_FIELDS_SQL} from tasks"


def written_tasks(spark, sf):
    path = new_path(spark, "tasks")
    document_sinks.write_task_state(
        ops.tasks(spark, sf), path, "run", "/data", "2024-01-01", "2024-03-01", documents=3, fingerprint={"list": "md5sum.txt", "size": "7"}
    )
    return path


@query("src_10_task_state", "tasks", _TASK_SQL)
def _(spark, sf):
    return documents.read_task_state(spark, written_tasks(spark, sf))


@query("snk_9_whole_document", "tasks", _TASK_SQL)
def _(spark, sf):
    path = f"{new_path(spark, 'tasks')}/state.json"
    document_sinks.write_task_document(ops.tasks(spark, sf), path, "run", "/data", "2024-01-01", "2024-03-01", {"list": "md5sum.txt"})
    return documents.read_document_entries(spark, path, documents.TASK_FIELDS).drop("name")


@query("snk_9_task_rows", "tasks", _TASK_SQL)
def _(spark, sf):
    path = new_path(spark, "tasks")
    document_sinks.write_task_rows(ops.tasks(spark, sf), path)
    return documents.read_task_rows(spark, path)


@query("snk_9_task_summaries", "tasks", (
    "select 'run' as run_id, '/data' as verification_dir, '2024-01-01' as created_at, '2024-03-01' as updated_at, 'md5sum.txt' as list, '7' as size, count(*) as total,"
    + ", ".join(f"count(case when status = '{s}' then 1 end) as {n}" for n, s in (
        ("fixed", "FIXED"), ("still_failed", "STILL_FAILED"), ("skipped", "SKIPPED_NO_ACCESSION"), ("retryable_failed", "FAILED_RETRYABLE"), ("fatal_failed", "FAILED_FATAL")))
    + " from tasks"
))
def _(spark, sf):
    heads = documents.read_task_heads(spark, written_tasks(spark, sf)).drop("document")
    fields = ("total", "fixed", "still_failed", "skipped", "retryable_failed", "fatal_failed")
    print_of = [F.col("input_fingerprint")[k].alias(k) for k in ("list", "size")]
    return heads.select("run_id", "verification_dir", "created_at", "updated_at", *print_of, *[F.col("summary")[n].alias(n) for n in fields]).distinct()


def checked(spark, sf):
    message = F.when(F.col("status") == "missing", F.concat(F.lit("File not found: "), "abs_path"))
    return ops.verification(spark, sf).select("file_path", "expected_hash", "computed_hash", "status", message.alias("error_message"))


_CHECKED = (
    f"v as (select file_path, expected_hash, computed_hash, {ops._STATE} as status, case when computed_hash is null then 'File not found: /data/' || file_path end as error_message from files)"
)


@query("src_11_failure_list", "files", "select status, file_path, expected_hash, computed_hash, coalesce(error_message, '') as error_message from v where status <> 'pass'", _CHECKED)
def _(spark, sf):
    path = new_path(spark, "failures")
    checksum_sinks.write_failure_list(checked(spark, sf), path, "/data", "2024-01-01 00:00:00")
    return lines.read_failures(spark, path)


@query("snk_10_failure_list", "files", in_order("section, path, k", (
    "select 0 as section, '' as path, unnest(range(3)) as k, unnest(['# MD5 Verification Failed Files', '# Generated: 2024-01-01 00:00:00', '# Verification Directory: /data']) as line"
    " union all select 1, '', 0, '# Total failed files: ' || count(*) from v where status <> 'pass'"
    " union all select 2, '', unnest(range(5)), unnest(['#', '# Format: STATUS | FILE_PATH | EXPECTED_HASH | COMPUTED_HASH | ERROR_MESSAGE', '# FILE_PATH is relative to the verification directory', '#' || repeat('=', 80), ''])"
    " union all select 3, file_path, 0, upper(status) || ' | ' || file_path || ' | ' || expected_hash || ' | ' || coalesce(computed_hash, 'N/A') || ' | ' || coalesce(error_message, '') from v where status <> 'pass'"
)), _CHECKED)
def _(spark, sf):
    path = new_path(spark, "failures")
    checksum_sinks.write_failure_list(checked(spark, sf), path, "/data", "2024-01-01 00:00:00")
    return read_in_order(spark, path)


def error_records(spark, sf):
    kind = F.col("error_type")
    return classified_errors(spark, sf).select(
        F.col("event_id").cast("double").alias("timestamp"), F.lit("t").alias("iso_timestamp"), "taxon", "error_type", "message",
        F.create_map(F.lit("try"), (F.col("event_id") % 3).cast("string")).alias("context"),
        messages.is_fatal(kind).alias("is_fatal"), messages.is_retryable(kind).alias("should_retry"),
        F.struct(F.col("exception_type").alias("type"), F.col("message"), F.lit(None).cast("string").alias("module")).alias("exception"),
    )


@query("src_12_error_log", "errors", f"select cast(event_id as double) as timestamp, taxon, {ERROR_CLASS_SQL} as error_type, cast(event_id % 3 as varchar) as attempt, exception_type from errors")
def _(spark, sf):
    path = new_path(spark, "log")
    records = error_records(spark, sf)
    line = F.explode(F.array(F.to_json(F.struct(*records.columns)), F.lit('{"timestamp": 1.0, "taxon')))
    write_lines(records.select("timestamp", line.alias("line")), path, ["timestamp", "line"])
    return documents.read_error_log(spark, path).select(
        "timestamp", "taxon", "error_type", F.col("context")["try"].alias("attempt"), F.col("exception.type").alias("exception_type")
    )


@query("snk_14_error_export", "errors", (
    f"select c.error_type, count(e.event_id) as n_errors, count(e.event_id) as n_records, (select count(*) from errors) as total_errors, 'now' as export_time"
    f" from (values ('environment'), ('filesystem'), ('transient'), ('data'), ('processing')) c(error_type) left join (select event_id, {ERROR_CLASS_SQL} as k from errors) e on e.k = c.error_type group by 1"
))
def _(spark, sf):
    path = new_path(spark, "export")
    document_sinks.write_errors(error_records(spark, sf), path, "now")
    record = spark.read.schema("total_errors BIGINT, export_time STRING, statistics MAP<STRING, BIGINT>").json(f"{path}/statistics")
    counts = record.select("total_errors", "export_time", F.explode("statistics").alias("error_type", "n_errors"))
    records = documents.read_error_log(spark, f"{path}/errors").groupBy("error_type").agg(F.count("*").alias("n_records"))
    return counts.join(records, "error_type", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)).cast("bigint"))


_FOLDER = "source || '/' || cast(floor(doc_id / 100) as bigint)"
_NAME = "'GCA_' || lpad(cast(doc_id as varchar), 9, '0') || '.1.fna'"


@query("src_13_inventory", "", f"select {_FOLDER} || '/' || {_NAME} as rel_path, strlen(text) as size, 'genome' as include_type from documents where doc_id % 17 <> 5")
def _(spark, sf):
    files = inventory.list_tree(spark, trees.file_tree(spark, sf))
    return inventory.requested_files(files, ["genome", "protein"]).select("rel_path", "size", "include_type")


@query("src_14_checksum_lists", "", f"select distinct {_FOLDER} || '/md5sum.txt' as rel_path, 'taxon' as layout from documents")
def _(spark, sf):
    return inventory.checksum_lists(inventory.list_tree(spark, trees.file_tree(spark, sf))).select("rel_path", "layout")


@query("src_15_lists_by_depth", "", f"select row_number() over (order by rel_path) as no, depth, rel_path from (select distinct 3 as depth, {_FOLDER} || '/md5sum.txt' as rel_path from documents)")
def _(spark, sf):
    found = inventory.lists_by_depth(inventory.list_tree(spark, trees.file_tree(spark, sf)))
    return ops.as_returned(found.select("depth", "rel_path"))


@query(
    "src_16_archive_members", "paths",
    "select 'package' || b || '/' || m as rel_path, regexp_extract(m, '[^/]*$') as name, 'package' || b || '.zip' as archive from (select distinct cast(floor(doc_id / 100) as bigint) as b from paths),"
    " unnest(['ncbi_dataset/fetch.txt', 'z/md5sum.txt', case when b % 2 = 1 then 'md5sum.txt' else 'a/md5sum.txt' end]) t(m)",
)
def _(spark, sf):
    found = archives.archive_members(inventory.list_tree(spark, trees.packages(spark, sf)))
    return found.filter("error IS NULL").select("rel_path", "name", F.substring_index("archive", "/", -1).alias("archive"))


@query(
    "src_16_downloaded_files", "",
    "select a as accession_id, a || case doc_id % 3 when 0 then '/ncbi_dataset/data/' || a || '/g.fna' else '/x/' || a || '.fna' end as rel_path from (select doc_id, 'GCA_' || lpad(cast(doc_id as varchar), 9, '0') || '.1' as a from documents)",
)
def _(spark, sf):
    accession = F.concat(F.lit("GCA_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".1"))
    nested = F.concat("a", F.lit("/x/"), "a", F.lit(".fna"))
    data = F.concat("a", F.lit("/ncbi_dataset/data/"), "a", F.lit("/g.fna"))
    both = F.when(F.col("doc_id") % 3 == 0, F.array(nested, data)).otherwise(F.array(nested, F.concat("a", F.lit(".zip"))))
    paths = given(spark, sf, "documents").select("doc_id", accession.alias("a")).select(F.explode(both).alias("rel_path"))
    files = paths.withColumns({"path": F.concat(F.lit("/dl/"), "rel_path"), "name": F.substring_index("rel_path", "/", -1)})
    return inventory.downloaded_files(files).select("accession_id", "rel_path")


@query(
    "pl_2_verify_tree", "files",
    f"select {_FOLDER} || '/' || {_NAME} as file_path, expected_hash, computed_hash, {ops._STATE} as status from files",
)
def _(spark, sf):
    return audit.verify_tree(spark, trees.file_tree(spark, sf)).files.select("file_path", "expected_hash", "computed_hash", "status")


@query("fn_20_file_md5", "", f"select {_FOLDER} || '/' || {_NAME} as rel_path, md5(text) as computed_hash from documents where doc_id % 17 <> 5")
def _(spark, sf):
    from cladeledger.functions.checksums import hash_files

    files = inventory.list_tree(spark, trees.file_tree(spark, sf))
    hashed = hash_files(inventory.requested_files(files, ["genome"]).select("path", "rel_path"))
    return hashed.select("rel_path", "computed_hash")


@query(
    "pl_3_plan_repair", "files",
    "select 'GCA_' || lpad(cast(doc_id as varchar), 9, '0') || '.1' as accession_id, sha256('/data' || chr(0) || source || chr(0) || regexp_extract(file_path, '[^/]*$') || chr(0) || expected_hash) as task_id,"
    f" case when doc_id % 4 = 0 then 'DOWNLOADED' else 'DOWNLOADING' end as status, file_path as original_path, {ops._STATE} as initial_status from files where {ops._STATE} <> 'pass'",
)
def _(spark, sf):
    cached = derived(spark, sf, "files").filter("doc_id % 4 = 0").select(
        F.substring_index("file_path", "/", -1).alias("name"), F.concat(F.lit("/cache/"), "file_path").alias("path")
    )
    plan = audit.plan_repair(checked(spark, sf), "/data", None, cached)
    return plan.tasks.select("accession_id", "task_id", "status", "original_path", "initial_status")


@query(
    "pl_3_plan_repair_saved", "files",
    "select 'GCA_' || lpad(cast(doc_id as varchar), 9, '0') || '.1' as accession_id, sha256('/data' || chr(0) || source || chr(0) || regexp_extract(file_path, '[^/]*$') || chr(0) || expected_hash) as task_id,"
    " case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'ORGANIZED' else 'DOWNLOADING' end as status,"
    " case when doc_id % 3 = 0 then 'kept' end as backup_path, case when doc_id % 3 = 0 then 'then' else 'now' end as created_at, case when doc_id % 3 = 0 then 4 else 0 end::bigint as attempts"
    f" from files where {ops._STATE} <> 'pass'",
)
def _(spark, sf):
    """A third of the tasks is saved from an interrupted run, half of those while they were verified."""
    failing_files = repair.failed_files(failing(checked(spark, sf)))
    known = derived(spark, sf, "files").select(F.col("file_path").alias("original_path"), "doc_id")
    saved = repair.new_tasks(failing_files, "/data", "then").join(known, "original_path").filter("doc_id % 3 = 0")
    status = F.when(F.col("doc_id") % 2 == 0, "VERIFYING").otherwise("DOWNLOADING")
    saved = saved.withColumns({"status": status, "backup_path": F.lit("kept"), "attempts": F.lit(4).cast("bigint")}).drop("doc_id")
    path = new_path(spark, "tasks")
    document_sinks.write_task_rows(saved, path)
    cached = spark.createDataFrame([], "name STRING, path STRING")
    plan = audit.plan_repair(checked(spark, sf), "/data", documents.read_task_rows(spark, path), cached, now="now")
    return plan.tasks.select("accession_id", "task_id", "status", "backup_path", "created_at", "attempts")


# Sinks ---------------------------------------------------------------------------------------------


def read_back(spark, path):
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_in_order(spark, path, *folders):
    """The lines with their place ``no`` in the written text, counted over its part files in order, per folder."""
    if folders:
        rows = materialize(lines.read_folders(spark, path, *folders).withColumnRenamed("line", "at"), "lines")
    else:
        rows = spark.read.text(path).select("value", lines.position().alias("at"))
    return with_row_number(rows, list(folders), [F.col("at")], "no").select(*folders, "no", F.col("value").alias("line"))


_GROUP_LINES = in_order("-size_bp, tax_id, part, child, child_id", (
    "select bin as group_id, size_bp, tax_id, 0 as part, '' as child, 0 as child_id, '# Species: ' || name || ' (' || tax_id || ')' as line from packed where bin is not null"
    " union all select bin, size_bp, tax_id, 1, '', 0, name || chr(9) || tax_id from packed where bin is not null union all select bin, size_bp, tax_id, 3, '', 0, '' from packed where bin is not null"
    " union all select p.bin, p.size_bp, p.tax_id, 2, t.name, t.tax_id, t.name || chr(9) || t.tax_id from packed p join c on c.ancestor = p.tax_id and c.descendant <> p.tax_id join taxonomy t on t.tax_id = c.descendant where p.bin is not null and t.tax_id in (select tax_id from genomes)"
), per="group_id")


@query("snk_1_group_files", "taxonomy genomes", _GROUP_LINES, ops.CAPACITY_CTE + ops.genus_ffd())
def _(spark, sf):
    tree, pairs = ops.pairs_at(spark, sf, "GENUS")
    sized = hierarchy.roll_up(pairs, ops.genomes(spark, sf)).join(tree.select("tax_id", "name"), "tax_id")
    packed = packing.pack(sized, ops.genus_capacity(spark, sf))
    path = new_path(spark, "groups")
    splits.write_groups(packed, hierarchy.descendants_with_genomes(pairs, tree, ops.genomes(spark, sf)), path)
    return read_in_order(spark, path, "group_id").withColumn("group_id", F.col("group_id").cast("bigint"))


@query("snk_2_exceeded_list", "taxonomy genomes", "select name || chr(9) || tax_id || chr(9) || size_bp as line from packed where bin is null", ops.CAPACITY_CTE + ops.genus_ffd())
def _(spark, sf):
    path = new_path(spark, "exceeded")
    splits.write_exceeded(ops.packed_genera(spark, sf), path)
    return read_back(spark, path)


_ACCESSION_SIZE = "select ancestor as k, accession as id, sequence_length as sz from c join genomes g on g.tax_id = c.descendant join taxonomy t on t.tax_id = ancestor where t.rnk = 'GENUS'"


@query(
    "snk_3_accession_bins", "taxonomy genomes",
    in_order("-sz, line", "select replace(t.name, ' ', '_') || '_' || t.tax_id || '_' || grp as file, st.id as line, g.sequence_length as sz from st join taxonomy t on t.tax_id = st.k join genomes g on g.accession = st.id where rn > 0", per="file"),
    ops._SIZES + ", " + ops.ffd_sql(_ACCESSION_SIZE, "1000000000"),
)
def _(spark, sf):
    tree, pairs = ops.pairs_at(spark, sf, "GENUS")
    members = hierarchy.genomes_below(pairs, ops.genomes(spark, sf)).select("taxon_id", "accession", "sequence_length")
    named = members.join(tree.select(F.col("tax_id").alias("taxon_id"), "name"), "taxon_id")
    binned = packing.pack_all(named, 1_000_000_000, "sequence_length", "accession", ["taxon_id"])
    path = new_path(spark, "accession-bins")
    splits.write_accession_bins(binned, path)
    return read_in_order(spark, path, "file")


def _disk_sql(factor: float) -> str:
    return f"'~' || printf('%.0f', round_even(gb * {factor}, 0)) || ' GB'"


_FIGURES = "'| ' || what || ' | ' || format('{:,}', n_species) || ' |', '| Total Genomes | ' || format('{:,}', n_genomes) || ' |', '| Total Size | ' || printf('%.2f', round_even(gb, 2)) || ' Gb |'"
_SUMMARY_SQL = in_order("section, id, k", (
    "select 0 as section, 0 as id, unnest(range(11)) as k, unnest(['# Task Split Results: ', '', '## Configuration', '', '- **Taxon**: All', '- **Taxonomy Level**: GENUS', '', '## Overall Statistics', '', '| Metric | Value |', '|--------|-------|']) as line"
    f" union all select 1, 0, unnest(range(3)), unnest([{_FIGURES}]) from (select *, 'Total Species' as what from sized where level = 'overall')"
    " union all select 2, 0, unnest(range(5)), unnest(['', '### Estimated Disk Space', '', '| Format | Estimated Disk Space |', '|--------|-------|'])"
    f" union all select 3, 0, unnest(range(3)), unnest(['| FASTA.GZ (compressed) | ' || {_disk_sql(0.3)} || ' |', '| FASTA (uncompressed) | ' || {_disk_sql(1.05)} || ' |', '| GenBank (with annotations) | ' || {_disk_sql(2.5)} || ' |']) from sized where level = 'overall'"
    " union all select 4, 0, unnest(range(5)), unnest(['', '## Group Details', '', '| Group | Species | Genomes | Size (Gb) | FASTA.GZ | FASTA | GenBank |', '|---|---|---|---|---|---|---|'])"
    f" union all select 5, group_id, 0, '| group' || group_id || ' | ' || format('{{:,}}', n_species) || ' | ' || format('{{:,}}', n_genomes) || ' | ' || printf('%.2f', round_even(gb, 2)) || ' | ' || {_disk_sql(0.3)} || ' | ' || {_disk_sql(1.05)} || ' | ' || {_disk_sql(2.5)} || ' |' from sized where level = 'group'"
    f" union all select 6, 0, unnest(range(8)), unnest(['', '## Exceeded Taxons', '', '| Metric | Value |', '|--------|-------|', {_FIGURES}]) from (select *, 'Exceeded Taxons' as what from sized where level = 'exceeded' and n_species > 0)"
    " union all select 7, 0, unnest(range(7)), unnest(['', '## Understanding Size Units', '', 'Sizes are in Gb (gigabases), the length of the sequences in units of 10^9 bases, not space on disk.', '', '## Output Files', ''])"
    " union all select 8, 0, 0, '- **Main Groups**: ' || count(case when level = 'group' then 1 end) || ' files' from sized"
    " union all select 8, 0, 1, '- **Exceeded Taxons**: ' || coalesce(max(case when level = 'exceeded' then n_species end), 0) || ' taxa' from sized"
    " union all select 8, 0, 2, '- **Secondary Splits**: accession files for each exceeded taxon' from sized where level = 'exceeded' and n_species > 0"
    " union all select 9, 0, unnest(range(6)), unnest(['', '### File Formats', '', '- Group files: a comment line for each taxon, then name, tab and id of the taxon and of all below it that have genomes, then an empty line.',"
    " '- Exceeded list: name, id and size in bases of each taxon, with tabs between them.', '- Secondary files: one accession per line.'])"
))


@query("snk_4_split_summary", "taxonomy genomes", _SUMMARY_SQL, ops.CAPACITY_CTE + ops.genus_ffd() + f", sized as (select *, size_bp / 1e9 as gb from ({ops._TOTALS}))")
def _(spark, sf):
    gigabases = ops.genus_capacity(spark, sf) / fixed.BASES_PER_GB
    plan = split.plan_split(ops.nodes(spark, sf), ops.genomes(spark, sf), "GENUS", gigabases)
    path = new_path(spark, "summary")
    splits.write_summary(plan.totals, {"Taxon": "All", "Taxonomy Level": "GENUS"}, path)
    return read_in_order(spark, path)


@query("snk_5_checksum_file", "manifest", in_order("filename", "select filename, expected_md5 || '  ' || filename as line from manifest"))
def _(spark, sf):
    """One file, read by the places of its ranges; the order is in the file."""
    path = f"{new_path(spark, 'checksums')}/md5sum.txt"
    index = write_lines_file(checksum_sinks.checksum_lines(manifest_rows(spark, sf)), path, ["filename"])
    found = read_text_file(spark, path, index)
    return with_row_number(found, [], [F.col("part"), F.col("line_no")], "no").select("no", "line")


@query("snk_5_checksum_list", "manifest", in_order("filename", "select filename, expected_md5 || '  ' || filename as line from manifest"))
def _(spark, sf):
    path = new_path(spark, "md5sum")
    checksum_sinks.write_checksum_list(derived(spark, sf, "manifest"), path)
    return read_in_order(spark, path)


@query(
    "snk_6_merged_list", "paths",
    in_order("place, out_name, k", (
        "select 1 as place, out_name, 0 as k, md5(arg_max(rel_path, doc_id)) || '  ' || out_name as line from plan group by out_name union all"
        " select 0, '', unnest(range(4)), unnest(['# MD5 checksums', '# Compatible with standard md5sum tools on Windows and Linux', '# Use ''md5sum -c md5sum.txt'' to verify file integrity', '#'])"
    )),
    f"{ops._TYPED}, {ops._LAYOUT}",
)
def _(spark, sf):
    from cladeledger.operators import layout

    listed = derived(spark, sf, "paths").select(
        F.col("path").alias("file_path"), F.md5("path").alias("expected_hash"), F.col("doc_id").alias("line")
    )
    mapping = layout.checksum_mapping(layout.rename_plan(ops.layout_files(spark, sf)))
    path = new_path(spark, "merged")
    checksum_sinks.write_merged_list(layout.merged_checksums(layout.resolve_names(listed, mapping)), path)
    return read_in_order(spark, path)


def _n(state: str) -> str:
    return f"count(case when status = '{state}' then 1 end)"


_REPORT = in_order("section, path, k", (
    "select 0 as section, '' as path, unnest(range(12)) as k, unnest([repeat('=', 60), 'MD5 VERIFICATION REPORT', repeat('=', 60), 'Total Files: ' || count(*),"
    f" 'Passed: ' || {_n('pass')}, 'Failed: ' || {_n('fail')}, 'Missing: ' || {_n('missing')}, 'Errors: ' || {_n('error')}, 'Processing Time: 0.00 seconds',"
    f" 'Success Rate: ' || printf('%.1f', round_even({_n('pass')} * 100.0 / count(*), 1)) || '%', repeat('=', 60), 'DETAILED RESULTS:']) as line from v"
    " union all select 1, file_path, 0, case status when 'pass' then '✓' when 'fail' then '✗' when 'missing' then '?' else '!' end || ' [' || upper(status) || '] ' || file_path from v"
    " union all select 1, file_path, 1, '  Hash: ' || expected_hash from v where status = 'pass' union all select 1, file_path, 2, '  Expected: ' || expected_hash from v where status = 'fail'"
    " union all select 1, file_path, 3, '  Computed: ' || computed_hash from v where status = 'fail' union all select 1, file_path, 4, '  Expected hash: ' || expected_hash from v where status = 'missing'"
    " union all select 1, file_path, 5, '  File not found' from v where status = 'missing'"
    " union all select 2, '', unnest(range(3)), unnest([repeat('=', 60), case when bool_and(status = 'pass') then '✓ All files verified successfully!' else '✗ Verification completed with issues. See details above.' end, repeat('=', 60)]) from v"
))


@query("snk_11_verification_report", "files", _REPORT, _CHECKED)
def _(spark, sf):
    path = new_path(spark, "report")
    verification = checked(spark, sf)
    checksum_sinks.write_report(verification, count_states(verification), path)
    return read_in_order(spark, path)


RUN = document_sinks.RepairRun("run", "/data", datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 13, 2, 3), 5, "/data/state.json")

_SECTION_SQL = (
    "rows as (select 0 as s, file_path as path, '' as id, file_path || ' [' || upper(status) || ']' as text,"
    " 'GCA_' || lpad(cast(doc_id as varchar), 9, '0') || '.1' as accession, error_message from (select v.*, files.doc_id from v join files using (file_path)) where status <> 'pass'"
    " union all select case status when 'FIXED' then 1 when 'SKIPPED_NO_ACCESSION' then 3 else 2 end, original_path, task_id, original_path, null, null from tasks"
    " where status in ('FIXED', 'SKIPPED_NO_ACCESSION', 'STILL_FAILED', 'FAILED_RETRYABLE', 'FAILED_FATAL')),"
    " placed as (select *, row_number() over (partition by s order by path, id) as n from rows),"
    " titles(s, title, intro, nothing) as (values (0, 'INITIALLY FAILED FILES', null, 'No files failed verification.'), (1, 'SUCCESSFULLY FIXED FILES', null, 'No files were successfully fixed.'),"
    " (2, 'STILL FAILED FILES', 'The following files still fail verification after redownload:', 'All redownloaded files passed verification.'),"
    " (3, 'SKIPPED FILES', 'The following files were skipped (no valid Accession ID):', 'No files were skipped.')),"
    " headed as (select titles.*, count(placed.s) as c from titles left join placed using (s) group by all)"
)


@query(
    "snk_12_repair_report", "tasks files",
    in_order("s, part, n, k", (
        "select -1 as s, 0 as part, 0 as n, unnest(range(11)) as k, unnest([repeat('=', 80), 'MD5 VERIFICATION AUTO-FIX REPORT', repeat('=', 80), '', 'Report Generated: 2024-01-01 13:02:03',"
        " 'Verification Directory: /data', '', 'Process Start Time: 2024-01-01 12:00:00', 'Process End Time: 2024-01-01 13:02:03', 'Total Processing Time: 1h 2m 3s', '']) as line"
        " union all select -1, 1, 0, unnest(range(12)), unnest([repeat('=', 80), 'SUMMARY', repeat('=', 80), '', 'Total Failed Files: ' || count(*), 'Files Redownloaded: ' || r, 'Files Organized: 5',"
        " 'Files Successfully Fixed: ' || f, 'Files Still Failed: ' || sf, 'Files Skipped: ' || sk, 'Success Rate: ' || printf('%.1f', round_even(f * 100.0 / r, 1)) || '%', ''])"
        " from (select unnest(range(count(*))), count(case when accession_id is not null and status <> 'SKIPPED_NO_ACCESSION' then 1 end) as r, count(case when status = 'FIXED' then 1 end) as f,"
        " count(case when status in ('STILL_FAILED', 'FAILED_RETRYABLE', 'FAILED_FATAL') then 1 end) as sf, count(case when status = 'SKIPPED_NO_ACCESSION' then 1 end) as sk from tasks) group by r, f, sf, sk"
        " union all select 4, 0, 0, unnest(range(3)), unnest([repeat('=', 80), 'END OF REPORT', repeat('=', 80)])"
        " union all select s, 0 as part, 0 as n, unnest(range(6)) as k, unnest([repeat('=', 80), title || ' (' || c || ' files)', repeat('=', 80), '', case when c = 0 then nothing else intro end, case when c > 0 and intro is not null then '' end]) as line from headed"
        " union all select s, 1, n, 0, n || '. ' || text from placed union all select s, 1, n, 1, '   Accession ID: ' || accession from placed union all select s, 1, n, 2, '   Error: ' || error_message from placed"
        " union all select s, 2, 0, 0, '' from titles"
    )).replace("from (select -1", "from (select * from (select -1") + " where line is not null)",
    _CHECKED + ", " + _SECTION_SQL,
)
def _(spark, sf):
    path = new_path(spark, "repair-report")
    failed = repair.failed_files(failing(checked(spark, sf)))
    document_sinks.write_repair_reports(failed, ops.tasks(spark, sf), path, RUN)
    return read_in_order(spark, f"{path}/files")


@query("snk_12_task_report", "tasks", in_order("section, item, k", (
    "select 0 as section, '' as item, unnest(range(11)) as k, unnest([repeat('=', 80), 'MD5 VERIFICATION AUTO-FIX RESUME REPORT', repeat('=', 80), '', 'Report Generated: 2024-01-01 13:02:03', 'Run ID: run', 'Verification Directory: /data', 'State File: /data/state.json', '', 'SUMMARY', repeat('-', 80)]) as line"
    " union all select 1, '', unnest(range(6)), unnest(["
    + ", ".join(f"'{n}: ' || {_n(st)}" for n, st in (("fatal_failed", "FAILED_FATAL"), ("fixed", "FIXED"), ("retryable_failed", "FAILED_RETRYABLE"), ("skipped", "SKIPPED_NO_ACCESSION"), ("still_failed", "STILL_FAILED")))
    + ", 'total: ' || count(*)]) from tasks union all select 2, '', unnest(range(3)), unnest(['', 'TASKS', repeat('-', 80)])"
    " union all select 3, original_path || chr(9) || task_id, 0, status || ' | ' || original_path from tasks"
    " union all select 3, original_path || chr(9) || task_id, 1, '  accession: ' || accession_id from tasks where accession_id is not null"
    " union all select 3, original_path || chr(9) || task_id, 3, '  backup_path: backups/' || original_path from tasks where event_id % 3 = 0"
    " union all select 4, '', unnest(range(5)), unnest(['', 'NEXT RUN', repeat('-', 80), 'Plan the repair again with this state; finished tasks are not repeated.', ''])"
)))
def _(spark, sf):
    path = new_path(spark, "repair-report")
    write_lines(document_sinks.task_report_lines(ops.tasks(spark, sf), RUN), path, document_sinks.REPORT_ORDER)
    return read_in_order(spark, path)


@query("snk_13_accession_list", "tasks", in_order("line", "select distinct accession_id as line from tasks where accession_id is not null"))
def _(spark, sf):
    path = new_path(spark, "accession-list")
    checksum_sinks.write_accessions(ops.tasks(spark, sf), path)
    return read_in_order(spark, path)


_TITLE = "upper(substr(error_type, 1, 1)) || substr(error_type, 2)"


@query(
    "ag_10_summary_report", "errors",
    in_order("section, item, k", (
        "select 0 as section, '' as item, unnest(range(11)) as k, unnest([repeat('=', 60), 'SUMMARY REPORT', repeat('=', 60), 'Total Taxa Processed: ' || count(*), 'Successful Downloads: 0', 'Failed Downloads: ' || count(*),"
        " 'Success Rate: 0.0%', 'Total Files Downloaded: 0', 'Total Processing Time: 60.00 seconds', 'Average Time per Taxon: ' || printf('%.2f', round_even(60.0 / count(*), 2)) || ' seconds', '']) as line from t"
        " union all select 1, '', unnest(range(2)), unnest(['ERROR STATISTICS:', repeat('-', 20)]) union all select 1, '~', 0, 'Total Errors: ' || count(*) from t"
        f" union all select 2, error_type, 0, '  ' || {_TITLE} || ': ' || count(*) || ' (' || printf('%.1f', round_even(count(*) * 100.0 / (select count(*) from t), 1)) || '%)'"
        " || case when error_type in ('environment', 'filesystem') then ' (FATAL)' when error_type = 'transient' then ' (RETRYABLE)' else '' end from t group by error_type"
        " union all select 3, '', unnest(range(3)), unnest(['', 'FAILED TAXA:', repeat('-', 15)])"
        f" union all select 4, error_type, unnest(range(2)), unnest(['', {_TITLE} || ' Errors (' || count(*) || ' taxa):']) from t group by error_type"
        " union all select 4, error_type || '-' || lpad(cast(p as varchar), 2, '0'), 0, '  - ' || taxon || ': ' || message from (select *, row_number() over (partition by error_type order by taxon, message) as p from t) where p <= 10"
        " union all select 4, error_type || '-~', 0, '  ... and ' || (count(*) - 10) || ' more' from t group by error_type having count(*) > 10"
    )),
    f"t as (select taxon || '-' || event_id as taxon, message, {ERROR_CLASS_SQL} as error_type from errors)",
)
def _(spark, sf):
    path = new_path(spark, "run-summary")
    taxon = F.concat("taxon", F.lit("-"), F.col("event_id").cast("string"))
    failed = classified_errors(spark, sf).select(
        taxon.alias("taxon"), F.lit(False).alias("success"), F.lit(0).cast("bigint").alias("files_found"), "error_type",
        F.col("message").alias("error_message"),
    )
    write_run_summary(failed, path, 60.0)
    return read_in_order(spark, path)


# Whole split plan ----------------------------------------------------------------------------------


@query("pl_1_plan_split", "taxonomy genomes", ops._TOTALS, ops.CAPACITY_CTE + ops.genus_ffd())
def _(spark, sf):
    gigabases = ops.genus_capacity(spark, sf) / fixed.BASES_PER_GB
    return split.plan_split(ops.nodes(spark, sf), ops.genomes(spark, sf), "genus", gigabases).totals


@query("pl_1_plan_groups", "taxonomy genomes", "select tax_id, name, size_bp, n_genomes, bin from packed", ops.CAPACITY_CTE + ops.genus_ffd())
def _(spark, sf):
    gigabases = ops.genus_capacity(spark, sf) / fixed.BASES_PER_GB
    packed = split.plan_split(ops.nodes(spark, sf), ops.genomes(spark, sf), "genus", gigabases).packed
    return packed.select("tax_id", "name", "size_bp", "n_genomes", "bin")


# Streams -------------------------------------------------------------------------------------------

_COMMIT_SQL = (
    "a as (select doc_id, case when doc_id % 60 = 1 then 'n' || (doc_id - 1) else 'n' || doc_id end as filename, md5(text) as md5, cast(floor(doc_id / 20) as bigint) as batch_num, doc_id % 2 as phase from documents),"
    " old as (select filename, md5 from a where phase = 0),"
    " bad as (select distinct a.batch_num from a join old using (filename) where a.phase = 1 and a.md5 <> old.md5)"
)


@query(
    "st_1_manifest_commits", "",
    "select filename, md5 as expected_md5 from old union all select filename, md5 from a where phase = 1 and batch_num not in (select batch_num from bad) and filename not in (select filename from old)",
    _COMMIT_SQL,
)
def _(spark, sf):
    source, path = new_path(spark, "artifacts"), new_path(spark, "commits")
    taken = F.col("doc_id") - F.when(F.col("doc_id") % 60 == 1, 1).otherwise(0)
    artifacts = given(spark, sf, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 20).alias("batch_num"), F.concat(F.lit("n"), taken.cast("string")).alias("filename"),
        F.md5("text").alias("expected_md5"), F.concat(F.lit("GCA_"), F.col("doc_id").cast("string")).alias("accession"),
    )
    schema = artifacts.drop("doc_id").schema
    for phase in (0, 1):
        artifacts.filter(F.col("doc_id") % 2 == phase).drop("doc_id").write.mode("append").parquet(source)
        stream = stream_of(spark, source, schema)
        commits.commit_artifacts(stream, path, availableNow=True).awaitTermination()
    return commits.manifest_of(spark, path).select("filename", "expected_md5")


@query(
    "st_1_chained_conflicts", "",
    "select distinct name as filename, md5 as expected_md5 from (select 'n' || doc_id as name, md5 from judged where ok"
    " union all select 'n' || (doc_id + 1), md5 from judged where ok and doc_id % 7 < 6)",
    "a as (select doc_id, md5(text) as md5 from documents), judged(doc_id, md5, ok) as (select doc_id, md5, true from a where doc_id % 7 = 0"
    " union all select a.doc_id, a.md5, not judged.ok or a.md5 = judged.md5 from judged join a on a.doc_id = judged.doc_id + 1 where a.doc_id % 7 > 0)",
)
def _(spark, sf):
    """Each download batch contradicts the one before it, within one micro-batch and over three."""
    source, path = new_path(spark, "artifacts"), new_path(spark, "commits")
    number = F.col("doc_id").cast("bigint")
    names = F.array(number, F.when(number % 7 < 6, number + 1))
    rows = given(spark, sf, "documents").select(
        number.alias("batch_num"), F.explode(F.array_compact(names)).alias("n"), F.md5("text").alias("expected_md5"),
        F.concat(F.lit("GCA_"), number.cast("string")).alias("accession"),
    ).withColumn("filename", F.concat(F.lit("n"), F.col("n").cast("string"))).drop("n")
    for phase in range(3):
        rows.filter(F.floor(F.col("batch_num") / 7) % 3 == phase).write.mode("append").parquet(source)
        stream = stream_of(spark, source, rows.schema)
        commits.commit_artifacts(stream, path, availableNow=True).awaitTermination()
    return commits.manifest_of(spark, path).select("filename", "expected_md5")


@query(
    "st_2_latest_task_states", "tasks",
    f"select task_id, status, accession_id, event_id as at, {ops._RECOVERED} as restart_status from"
    " (select md5sum_dir as task_id, arg_max(status, event_id) as status, arg_max({'a': accession_id}, event_id).a as accession_id, max(event_id) as event_id from tasks group by 1)",
)
def _(spark, sf):
    """All events of a user as those of one task; the streamed restart state follows the batch rule."""
    source, path = new_path(spark, "task-events"), new_path(spark, "task-states")
    events = derived(spark, sf, "tasks").select(
        F.col("md5sum_dir").alias("task_id"), F.col("event_id").alias("seq"), "status", "accession_id",
        F.col("original_path").alias("target_path"), "expected_hash",
    )
    events.write.parquet(source)
    latest = task_streams.latest_task_states(stream_of(spark, source, events.schema), ops.task_hashes(spark, sf), F.col("seq"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/now")

    latest.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(f"{path}/now")


_AFTER = (
    "case when not legal then s.status when kind = 'update' then e.status"
    " when kind = 'retry' then case when s.status in ('STILL_FAILED', 'FAILED_RETRYABLE') then 'DOWNLOAD_QUEUED' else s.status end"
    " when accession_id is null then case when s.status in ('FIXED', 'SKIPPED_NO_ACCESSION') then s.status else 'SKIPPED_NO_ACCESSION' end"
    " when s.status = 'FIXED' and not fix_holds then 'DOWNLOAD_QUEUED'"
    " when s.status in ('PENDING', 'DOWNLOADING', 'FAILED_RETRYABLE') then 'DOWNLOAD_QUEUED' when s.status = 'ORGANIZING' then 'DOWNLOADED'"
    " when s.status = 'VERIFYING' then 'ORGANIZED' else s.status end"
)
_EVENTS_SQL = (
    "ev as (select md5sum_dir as task_id, event_id, case when event_id % 7 = 0 then 'retry' when event_id % 7 = 1 then 'recover' when event_id % 43 = 2 then 'pause' else 'update' end as kind,"
    " case when event_id % 31 = 7 then 'BROKEN' else status end as status, accession_id, event_id % 3 <> 0 as fix_holds from tasks),"
    " judged as (select *, kind in ('retry', 'recover') or kind = 'update' and status <> 'BROKEN' as legal, event_id * 3 // (select max(event_id) + 1 from ev) as own_phase from ev),"
    " sent as (select *, own_phase + (event_id % 17 = 3)::int as phase, 0 as copy from judged union all select *, own_phase + 1, 1 from judged where event_id % 19 = 5),"
    " bounds as (select p.phase, (select max(event_id) - 100 from sent where phase < p.phase) as bound from (select distinct phase from sent) p),"
    " told as (select sent.*, coalesce(event_id < bound, false) as late from sent join bounds using (phase)),"
    " placed as (select *, row_number() over (partition by task_id, event_id, late order by phase, copy) as time from told)"
)


def _fold_sql(events: str) -> str:
    """Table ``st``: the states of each task event by event, from ``events`` in order."""
    return (
        f"e as (select *, row_number() over (partition by task_id order by event_id) as no from ({events})),"
        " st(task_id, no, status, attempts, n_illegal) as (select distinct task_id, 0::bigint, 'PENDING', 0::bigint, 0::bigint from e union all"
        f" select e.task_id, e.no, {_AFTER}, attempts + (legal and kind = 'retry' and s.status in ('STILL_FAILED', 'FAILED_RETRYABLE'))::int,"
        " n_illegal + (not legal)::int from st s join e on e.task_id = s.task_id and e.no = s.no + 1)"
    )


_FINAL_STATES = "select task_id, arg_max(status, no) as status, arg_max(attempts, no) as attempts, max(no) as n_events, arg_max(n_illegal, no) as n_illegal from st group by 1"


def _task_events(spark, sf):
    """Events of a user as those of one task, one a second: updates, retries, recoveries, and some of no known kind or status."""
    number = F.col("event_id")
    kind = F.when(number % 7 == 0, "retry").when(number % 7 == 1, "recover").when(number % 43 == 2, "pause").otherwise("update")
    return derived(spark, sf, "tasks").select(
        F.col("md5sum_dir").alias("task_id"), "event_id", F.timestamp_seconds(number).alias("at"), kind.alias("kind"),
        F.when(number % 31 == 7, "BROKEN").otherwise(F.col("status")).alias("status"), "accession_id", (number % 3 != 0).alias("fix_holds"),
    )


@query("st_2_task_machine", "tasks", _FINAL_STATES, f"{_EVENTS_SQL}, {_fold_sql('select * from judged')}")
def _(spark, sf):
    """All events at once, in runs of eight."""
    return task_machine.final_states(_task_events(spark, sf).unionByName(_task_events(spark, sf).filter("event_id % 19 = 5")), run=8)


@query(
    "st_2_streamed_task_machine", "tasks",
    "select f.*, coalesce(n_late, 0) as n_late, coalesce(n_repeated, 0) as n_repeated from"
    f" ({_FINAL_STATES}) f left join (select task_id, count(*) filter (late) as n_late, count(*) filter (not late and time > 1) as n_repeated from placed group by 1) using (task_id)",
    f"{_EVENTS_SQL}, {_fold_sql('select * from placed where not late and time = 1')}",
)
def _(spark, sf):
    """Four batches; some events come a batch too late, some twice."""
    source, path = new_path(spark, "task-events"), new_path(spark, "task-states")
    events = materialize(_task_events(spark, sf), "events")
    total = events.agg(F.max("event_id") + 1).first()[0]
    own = F.expr(f"event_id * 3 div {total}")
    sent = events.withColumn("phase", own + F.when(F.col("event_id") % 17 == 3, 1).otherwise(0))
    sent = sent.unionByName(events.withColumn("phase", own + 1).filter("event_id % 19 = 5"))
    for phase in range(4):
        sent.filter(F.col("phase") == phase).drop("phase").write.mode("append").parquet(source)
        stream = stream_of(spark, source, events.schema)
        task_streams.track_tasks(stream, path, "100 seconds", availableNow=True).awaitTermination()
    sections = spark.read.parquet(f"{path}/sections")
    apart = sections.groupBy("task_id").agg(
        F.count_if(F.col("section") == "late").alias("n_late"), F.count_if(F.col("section") == "repeated").alias("n_repeated")
    )
    return task_streams.current_states(sections).join(apart, "task_id")


@query("st_3_streamed_levels", "metrics", ops._HYSTERESIS)
def _(spark, sf):
    source, path = new_path(spark, "metrics"), new_path(spark, "levels")
    metrics = derived(spark, sf, "metrics")
    middle = metrics.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    for part in (metrics.filter(F.col("seq") <= middle), metrics.filter(F.col("seq") > middle)):
        part.write.mode("append").parquet(source)
        stream = stream_of(spark, source, metrics.schema)
        level_streams.track_levels(
            stream, path, "entity", [F.col("seq")], F.col("free_permille") / F.lit(1000.0), availableNow=True
        ).awaitTermination()
    found = spark.read.parquet(f"{path}/levels")
    return found.select("entity", "seq", F.col("level_rank").cast("bigint").alias("level_rank"), "level")
