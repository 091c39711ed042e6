"""Catalogue, hierarchy, file and event tables derived from the given tables.

Each table is one SELECT that Spark and the checking engine both run; ``{orders}`` stands for the
given table of that name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    # Catalogue of genomes; some taxa have many.
    "genomes": """
        select concat(case when o_orderkey % 3 = 0 then 'GCF_' else 'GCA_' end,
                      lpad(cast(o_orderkey as varchar(20)), 9, '0'), '.',
                      cast(1 + o_orderkey % 4 as varchar(20))) as accession,
               concat('Organism ', cast(o_custkey as varchar(20))) as organism_name,
               cast(1000000 + o_custkey as bigint) as tax_id,
               cast(round(o_totalprice * 100) as bigint) as sequence_length
        from {orders}""",
    "taxonomy": """
        select cast(1 + r_regionkey as bigint) as tax_id, r_name as name, 'PHYLUM' as rnk,
               cast(null as bigint) as parent from {region}
        union all
        select cast(1000 + n_nationkey as bigint), n_name, 'GENUS', cast(1 + n_regionkey as bigint) from {nation}
        union all
        select cast(1000000 + c_custkey as bigint), c_name, 'SPECIES', cast(1000 + c_nationkey as bigint)
        from {customer}""",
    # Names that break each naming rule in turn.
    "names": """
        select p_partkey,
               case p_partkey % 23
                 when 0 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' sp.')
                 when 1 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' 2')
                 when 2 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), '-var')
                 when 3 then p_name
                 when 4 then concat('  ', upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', '   '), ' ')
                 when 5 then concat(upper(substr(p_name, 1, 1)), 'x bacterium')
                 when 6 then concat(upper(substr(p_name, 1, 1)), 'yx strain')
                 when 7 then concat(upper(substr(p_name, 1, 1)), 'yx sp')
                 when 8 then upper(p_name)
                 when 9 then concat(upper(substr(p_name, 1, 1)), 'b ccc')
                 when 10 then concat(upper(substr(p_name, 1, 1)), 'bc dd')
                 when 11 then concat(upper(substr(p_name, 1, 1)), 'bc-def ghi')
                 when 12 then concat(upper(substr(p_name, 1, 1)), 'bcd Efg')
                 when 13 then concat(upper(substr(p_name, 1, 1)), 'bcd ef-gh')
                 when 14 then 'Single'
                 when 15 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' third')
                 when 16 then ''
                 when 17 then cast(null as varchar(20))
                 when 18 then concat(upper(substr(p_name, 1, 1)), 'aBc defg')
                 when 19 then concat('Uncultured ', substr(p_name, 1, 3))
                 else concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) end as name
        from {part}""",
    # Checked files: some hashes are wrong, some files absent.
    "files": """
        select concat(source, '/GCA_', lpad(cast(doc_id as varchar(20)), 9, '0'), '.1.fna') as file_path,
               case when doc_id % 10 = 3 then md5(concat(text, 'x')) else md5(text) end as expected_hash,
               case when doc_id % 17 = 5 then null else md5(text) end as computed_hash,
               doc_id, source
        from {documents}""",
    # Package paths of every file type and prefix.
    "paths": """
        select doc_id,
               concat('GC', case when doc_id % 2 = 0 then 'F' else 'A' end, '_',
                      lpad(cast(doc_id as varchar(20)), case when doc_id % 5 = 0 then 6 else 9 end, '0'), '.',
                      cast(1 + doc_id % 11 as varchar(20))) as acc,
               concat(case doc_id % 7 when 0 then './ncbi_dataset/data/' when 1 then 'ncbi_dataset/data/'
                        when 2 then './data/' when 3 then '/data/' when 4 then '' when 5 then './' else '/other/' end,
                      'GC', case when doc_id % 2 = 0 then 'F' else 'A' end, '_',
                      lpad(cast(doc_id as varchar(20)), case when doc_id % 5 = 0 then 6 else 9 end, '0'), '.',
                      cast(1 + doc_id % 11 as varchar(20)), '/',
                      case doc_id % 13
                        when 0 then 'protein.faa' when 1 then 'cds_from_genomic.fna' when 2 then 'rna.fna'
                        when 3 then 'genomic.gff' when 4 then 'genomic.GFF3' when 5 then 'genomic.gtf'
                        when 6 then 'genomic.gbff' when 7 then 'sequence_report.jsonl'
                        when 8 then 'assembly_data_report.jsonl' when 9 then 'genome.fasta'
                        when 10 then concat('gca_', lpad(cast(doc_id as varchar(20)), 9, '0'), '.2_ASM_genomic.fna')
                        when 11 then 'archive.tar.gz' else 'readme' end) as path
        from {documents}""",
    # Lines of checksum lists in all the forms met in practice.
    "checksum_lines": """
        select doc_id,
               case doc_id % 9
                 when 0 then concat(md5(text), '  ', source, '/a', cast(doc_id as varchar(20)), '.fna')
                 when 1 then concat(upper(md5(text)), ' *a', cast(doc_id as varchar(20)), '.fna')
                 when 2 then concat('MD5 (dir/a', cast(doc_id as varchar(20)), '.faa) = ', md5(text))
                 when 3 then concat('# note ', cast(doc_id as varchar(20)))
                 when 4 then '   '
                 when 5 then concat(substr(md5(text), 1, 30), '  short.fna')
                 when 6 then concat('  ', md5(text), '   name with space ', cast(doc_id as varchar(20)), '.gff  ')
                 when 7 then concat('zz', substr(md5(text), 3), '  b', cast(doc_id as varchar(20)), '.fna')
                 else concat(md5(text), '  d', chr(92), cast(doc_id as varchar(20)), '.fna') end as line
        from {documents}""",
    "task_events": "select user_id as task, event_id as seq, ts, event_type as status from {events}",
    # Repair tasks in every state.
    "tasks": """
        select event_id,
               concat('t', cast(event_id as varchar(20))) as task_id,
               case event_id % 12
                 when 0 then 'PENDING' when 1 then 'SKIPPED_NO_ACCESSION' when 2 then 'DOWNLOAD_QUEUED'
                 when 3 then 'DOWNLOADING' when 4 then 'DOWNLOADED' when 5 then 'ORGANIZING' when 6 then 'ORGANIZED'
                 when 7 then 'VERIFYING' when 8 then 'FIXED' when 9 then 'STILL_FAILED'
                 when 10 then 'FAILED_RETRYABLE' else 'FAILED_FATAL' end as status,
               case when event_id % 5 = 4 then null
                    else concat('GCA_', lpad(cast(event_id as varchar(20)), 9, '0'), '.1') end as accession_id,
               concat('GCA_', lpad(cast(event_id as varchar(20)), 9, '0'), '.1.fna') as md5_file_path,
               cast(user_id as varchar(20)) as md5sum_dir,
               concat(cast(user_id as varchar(20)), '/GCA_', lpad(cast(event_id as varchar(20)), 9, '0'), '.1.fna')
                 as original_path,
               md5(cast(event_id as varchar(20))) as expected_hash,
               cast(event_id % 3 as bigint) as attempts
        from {events}""",
    "metrics": "select user_id as entity, event_id as seq, cast((event_id * 37) % 400 as bigint) as free_permille from {events}",
    "requested": "select l_orderkey as item, l_linenumber as line_number from {lineitem}",
    "completed": "select o_orderkey as item from {orders} where o_orderstatus = 'F'",
    "manifest": "select file_path as filename, expected_hash as expected_md5 from (<files>) f where doc_id % 3 <> 0",
    "batch": """
        select file_path as filename,
               case when doc_id % 50 = 1 then md5(expected_hash) else expected_hash end as expected_md5,
               cast(floor(doc_id / 20) as bigint) as batch_num
        from (<files>) f where doc_id % 3 <> 1 or doc_id % 50 = 1""",
    "errors": """
        select cast(user_id as varchar(20)) as taxon, event_id,
               case event_id % 11 when 0 then 'Read timeout after 30s' when 1 then 'Permission denied: /out'
                 when 2 then 'no genomes for taxon' when 3 then 'Connection refused by host'
                 when 4 then 'HTTP 429 Too Many Requests' when 5 then 'No space left on device'
                 when 6 then 'datasets not found in PATH' when 7 then 'rate limit: no genome data for it'
                 when 8 then 'status 503 from server' when 9 then 'access to disk failed' else 'bad zip member' end
                 as message,
               case event_id % 7 when 0 then 'OSError' when 1 then 'ValueError' when 2 then 'TimeoutError'
                 else 'RuntimeError' end as exception_type
        from {events} where event_type = 'error'""",
    # Results per taxon and per download batch.
    "taxon_results": """
        select c_custkey as taxon, c_acctbal > 2000 as success, cast(c_custkey % 9 as bigint) as files_found
        from {customer}""",
    "saved_files": """
        select concat('GCA_', lpad(cast(l_orderkey as varchar(20)), 9, '0'), '.1') as accession,
               case l_linenumber when 1 then 'genome' when 2 then 'protein' when 3 then 'gff3' when 4 then 'cds'
                 else 'gtf' end as include_type
        from {lineitem}""",
}


def select_text(name: str) -> str:
    """The SELECT of a table with the tables it builds on put in."""
    return re.sub(r"<(\w+)>", lambda m: select_text(m.group(1)), TABLES[name])


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = select_text(name)
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: given(spark, sf_dir, t) for t in used})


def oracle_text(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", select_text(name))
