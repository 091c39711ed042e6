"""Sources, sinks and streams on small folders."""

import json
import random
import tempfile
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladeledger import workspace
from cladeledger.functions.checksums import hash_files
from cladeledger.operators import manifest
from cladeledger.plans import audit
from cladeledger.sinks import checksums as checksum_sinks
from cladeledger.sinks import documents as document_sinks
from cladeledger.sinks import single_file
from cladeledger.sinks.lines import write_lines
from cladeledger.sinks.reports import run_summary_lines
from cladeledger.sources import archives, catalogue, documents, inventory, lines
from cladeledger.streaming import commits
from cladeledger.streaming.levels import track_levels
from cladeledger.streaming.state import stream_of
from cladeledger.streaming.tasks import current_states, track_tasks

EMPTY = "d41d8cd98f00b204e9800998ecf8427e"


def test_catalogue_modes(spark, tmp_path):
    head = "Assembly Accession\tOrganism Name\tOrganism Taxonomic ID\tOther\tAssembly Stats Total Sequence Length"
    (tmp_path / "c.tsv").write_text(head + "\nGCA_1\tX\t 5 \t\t100\n\tY\t5\t\t1\nGCA_2\tZ\t\t\t1\nGCA_3\tZ\tabc\t\t1\n")
    path = str(tmp_path / "c.tsv")
    assert [tuple(r) for r in catalogue.read_catalogue(spark, path, "permissive").collect()] == [("GCA_1", "X", 5, 100)]
    with pytest.raises(Exception, match="GCA_3 has tax_id 'abc'"):
        catalogue.read_catalogue(spark, path).collect()


def test_catalogue_columns_are_found_by_name(spark, tmp_path):
    names = ["Assembly Accession", "Organism Name", "Organism Taxonomic ID", "Assembly Stats Total Sequence Length"]
    for i, order in enumerate([(0, 1, 2, 3), (3, 0, 2, 1), (0, 1, 2, 3)]):
        row = [f"GCA_{i}", "X y", "12", "2000"]
        (tmp_path / f"c {i}+.tsv").write_text("\t".join(names[k] for k in order) + "\n" + "\t".join(row[k] for k in order) + "\n")
    want = {(f"GCA_{i}", "X y", 12, 2000) for i in range(3)}
    for path in (str(tmp_path / "*.tsv"), [str(p) for p in tmp_path.glob("*.tsv")]):
        assert {tuple(r) for r in catalogue.read_catalogue(spark, path).collect()} == want


def test_list_lines_do_not_depend_on_the_size_of_a_file(spark, tmp_path, monkeypatch):
    """One rule at any size: only \\n, \\r\\n and \\r end a line."""
    names = ["a\x0bb.fna", "c\u2028d.fna", "e\x85f.fna", "g h.fna", "i\x1cj.fna"]
    ends = ["\n", "\r\n", "\r", "\r\n", ""]
    text = "".join(f"{EMPTY}  {n}{e}" for n, e in zip(names, ends))
    path = tmp_path / "md5sum.txt"
    path.write_bytes(text.encode())
    (tmp_path / "empty.txt").write_text("")
    lists = spark.createDataFrame([(str(path), len(text.encode())), (str(tmp_path / "empty.txt"), 0)], "path STRING, size BIGINT")
    for step in (1, 2, 7, 39, 40, 1 << 20):
        monkeypatch.setattr(lines, "RANGE_BYTES", step)
        entries = lines.checksum_entries(lines.read_many_lists(lists)).orderBy("line").collect()
        assert [r.file_path for r in entries] == names, step
    spark_rule = lines.read_checksums(spark, str(path)).orderBy("line").collect()
    assert [r.file_path for r in spark_rule] == names


def test_taxonomy_rejects_bad_lines(spark, tmp_path):
    good = {"taxonomy": {"taxId": 1, "rank": "genus", "currentScientificName": {"name": "A"}}}
    (tmp_path / "t.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps({"taxonomy": {"rank": "x"}}) + "\n")
    row = catalogue.read_taxonomy(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r.tax_id, r.name, r.rank, r.classification, r.parent_ids) for r in row] == [(1, "A", "GENUS", {}, [])]
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="Malformed"):
        catalogue.read_taxonomy(spark, str(tmp_path / "bad.jsonl")).collect()


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("GCA_2\n\n GCA_1 \nGCA_2\n")
    rows = lines.read_accessions(spark, str(tmp_path / "a.txt")).orderBy("line").collect()
    assert [(r.accession, r.copies) for r in rows] == [("GCA_2", 2), ("GCA_1", 1)]
    (tmp_path / "t.txt").write_text("# c\n562\nEscherichia\t562\nEmpty\t \nEscherichia coli\n")
    assert [r.taxon for r in lines.read_taxa(spark, str(tmp_path / "t.txt")).orderBy("line").collect()] == [
        "562", "562", "Empty", "Escherichia coli",
    ]
    (tmp_path / "e.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        lines.read_accessions(spark, str(tmp_path / "e.txt"))


def test_latin_lists_are_decoded(spark, tmp_path):
    (tmp_path / "l.md5").write_bytes(f"{EMPTY}  é.fna\nMD5 (x.fna) = {EMPTY}\n".encode("latin-1"))
    (tmp_path / "u.md5").write_bytes(f"{EMPTY}  ü.fna\n".encode())
    found = lines.read_checksums_lenient(spark, str(tmp_path)).collect()
    assert {r.file_path for r in found} == {"é.fna", "x.fna", "ü.fna"}


def test_failure_list_round_trip(spark, tmp_path):
    rows = [("a", EMPTY, None, "missing", "x | y"), ("b", EMPTY, EMPTY, "pass", None), ("c", EMPTY, "0", "fail", None)]
    df = spark.createDataFrame(rows, "file_path STRING, expected_hash STRING, computed_hash STRING, status STRING, error_message STRING")
    path = str(tmp_path / "failures")
    checksum_sinks.write_failure_list(df, path, "/data", "now")
    found = {tuple(r) for r in lines.read_failures(spark, path).collect()}
    assert found == {("missing", "a", EMPTY, None, "x | y"), ("fail", "c", EMPTY, "0", "")}
    assert [r.root for r in lines.read_failure_root(spark, path).collect()] == ["/data"]


def test_other_manifest_versions_fail(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 2, "artifacts": {"a": {"accession": "A"}}}))
    with pytest.raises(Exception, match="Unsupported accession manifest schema: 2"):
        documents.read_manifest(spark, str(tmp_path / "m.json")).collect()


def test_manifest_documents_round_trip(spark, tmp_path):
    rows = [(f"A.{i}", "genome", f'f"{i}.fna', str(i), "s") for i in range(50)]
    df = spark.createDataFrame(rows, "accession STRING, include_type STRING, filename STRING, expected_md5 STRING, checksum_source STRING")
    for parts in (7, 1):
        path = str(tmp_path / f"m{parts}")
        document_sinks.write_manifest(df, path, "2024-01-01T00:00:00Z", parts)
        back = documents.read_manifest(spark, path)
        assert {(r.accession, r.filename, r.expected_md5) for r in back.collect()} == {(r[0], r[2], r[3]) for r in rows}
    whole = [json.loads(p.read_text()) for p in (tmp_path / "m1").glob("part*")]
    assert len(whole) == 1 and whole[0]["schema_version"] == 1
    assert list(whole[0]["artifacts"]) == sorted(whole[0]["artifacts"])


@pytest.mark.parametrize("n", [10, 200_000])
def test_the_form_does_not_depend_on_the_number_of_entries(spark, tmp_path, n):
    name = F.concat(F.lit("A."), F.col("id").cast("string"))
    rows = spark.range(n).select(name.alias("accession"), F.lit("genome").alias("include_type"), name.alias("filename"), F.lit("0").alias("expected_md5"), F.lit("s").alias("checksum_source"))
    document_sinks.write_manifest_rows(rows, str(tmp_path / "m"), "now")
    assert documents.read_manifest_rows(spark, str(tmp_path / "m")).agg(F.count_distinct("filename")).first()[0] == n
    document_sinks.write_manifest(rows, str(tmp_path / "d"), "now", 1)
    assert len(list((tmp_path / "d").glob("part*"))) == 1
    states = rows.select(F.col("accession").alias("item"), F.lit("failed").alias("state"))
    document_sinks.write_progress_rows(states, str(tmp_path / "p"))
    assert documents.read_progress_rows(spark, str(tmp_path / "p")).count() == n


def test_directories_and_unreadable_ones_are_errors(spark, tmp_path, monkeypatch):
    make_tree(tmp_path / "data")
    (tmp_path / "data" / "t2" / "sub").mkdir()
    (tmp_path / "data" / "t2" / "md5sum.txt").write_text(f"{EMPTY}  sub\n{EMPTY}  gone.fna\n{EMPTY}  closed/deep/x.fna\n")
    entries = inventory.list_entries(spark, str(tmp_path / "data"))
    closed = spark.createDataFrame([(f"{tmp_path}/data/t2/closed", "t2/closed", "closed", 0, 0.0, True, "Permission denied: x")], entries.schema)
    found = {r.file_path: (r.status, r.error_message) for r in audit.verify_tree(spark, str(tmp_path / "data"), entries.union(closed)).files.collect()}
    assert found["t2/sub"][0] == "error" and "directory" in found["t2/sub"][1]
    assert found["t2/closed/deep/x.fna"] == ("error", "Permission denied: x")
    assert found["t2/gone.fna"][0] == "missing"

    def refuse(path):
        raise PermissionError("no")

    monkeypatch.setattr(inventory.os, "scandir", refuse)
    assert list(inventory._entries("/x")) == [("/x", True, 0, 0.0, "Permission denied: no")]


def test_broken_states_are_ignored(spark, tmp_path):
    (tmp_path / "p.json").write_text("{broken")
    assert documents.read_progress(spark, str(tmp_path / "p.json")).isEmpty()
    assert documents.read_task_state(spark, str(tmp_path / "p.json")).isEmpty()


def test_lines_keep_their_order_over_part_files(spark, tmp_path):
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("n"), F.concat(F.lit("l"), (F.lit(4999) - F.col("id")).cast("string")).alias("line"))
    write_lines(df.repartition(7), str(tmp_path / "o"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part*")))
    assert text.splitlines() == [f"l{i}" for i in range(5000)]


def make_tree(root):
    (root / "t1").mkdir(parents=True)
    (root / "t2").mkdir()
    (root / "t1" / "GCA_000000001.1.fna").write_text("")
    (root / "t1" / "GCA_000000002.1.fna").write_text("other")
    (root / "t1" / "md5sum.txt").write_text(f"{EMPTY}  GCA_000000001.1.fna\n{EMPTY}  GCA_000000002.1.fna\n")
    (root / "t2" / ".hidden.fna").write_text("")
    (root / "t2" / "md5sum.txt").write_text(f"{EMPTY}  .hidden.fna\n{EMPTY}  gone.fna\nbad line\n{EMPTY}  ../t1/GCA_000000001.1.fna\n")


def test_verify_tree(spark, tmp_path):
    make_tree(tmp_path / "data")
    result = audit.verify_tree(spark, str(tmp_path / "data"))
    assert {(r.file_path, r.status) for r in result.files.collect()} == {
        ("t1/GCA_000000001.1.fna", "pass"), ("t1/GCA_000000002.1.fna", "fail"), ("t2/.hidden.fna", "pass"), ("t2/gone.fna", "missing"),
    }
    totals = result.totals.first()
    assert (totals.total_files, totals.passed, totals.failed, totals.missing, totals.exit_code) == (5, 3, 1, 1, 1)
    assert totals.counts_valid


def test_entries_outside_the_tree_and_links(spark, tmp_path):
    make_tree(tmp_path / "data")
    (tmp_path / "other.fna").write_text("")
    (tmp_path / "data" / "loop").symlink_to(tmp_path / "data")
    (tmp_path / "data" / "broken.fna").symlink_to(tmp_path / "none")
    (tmp_path / "data" / "t3").mkdir()
    (tmp_path / "data" / "t3" / "md5sum.txt").write_text(f"{EMPTY}  ../../other.fna\n{EMPTY}  {tmp_path}/absent.fna\n")
    found = {r.file_path: r.status for r in audit.verify_tree(spark, str(tmp_path / "data")).files.collect()}
    assert found["../../other.fna"] == "pass" and found[f"{tmp_path}/absent.fna"] == "missing" and len(found) == 6


def test_run_summary(spark):
    rows = [(f"t{i}", i % 2 == 0, i, "data" if i % 4 == 1 else "transient", "m") for i in range(60)]
    df = spark.createDataFrame(rows, "taxon STRING, success BOOLEAN, files_found BIGINT, error_type STRING, error_message STRING")
    lines_df = run_summary_lines(df, 120.0)
    text = [r.line for r in lines_df.orderBy("section", "item", "part").collect()]
    assert text[3:9] == [
        "Total Taxa Processed: 60", "Successful Downloads: 30", "Failed Downloads: 30", "Success Rate: 50.0%",
        "Total Files Downloaded: 870", "Total Processing Time: 120.00 seconds",
    ]
    assert "  Transient: 15 (50.0%) (RETRYABLE)" in text
    data = text.index("Data Errors (15 taxa):")
    assert text[data + 1] == "  - t1: m" and text[data + 11] == "  ... and 5 more"


def test_paths_with_odd_characters(spark, tmp_path):
    root = tmp_path / "a b+c%20é"
    make_tree(root)
    found = lines.read_checksums(spark, str(root / "t1" / "md5sum.txt")).collect()
    assert {r.abs_path for r in found} == {str(root / "t1" / f"GCA_00000000{i}.1.fna") for i in (1, 2)}
    assert audit.verify_tree(spark, str(root)).totals.first().passed == 3


def test_uri_root(spark, tmp_path):
    make_tree(tmp_path / "data")
    result = audit.verify_tree(spark, f"file://{tmp_path}/data")
    assert result.totals.first().passed == 3
    assert "t1/GCA_000000001.1.fna" in {r.file_path for r in result.files.collect()}


def test_flat_layout_reads_the_root_list_only(spark, tmp_path):
    root = tmp_path / "flat"
    (root / "a" / "b").mkdir(parents=True)
    (root / "x.fna").write_text("")
    (root / "md5sum.txt").write_text(f"{EMPTY}  x.fna\n")
    (root / "a" / "b" / "md5sum.txt").write_text(f"{EMPTY}  y.fna\n")
    files = inventory.list_tree(spark, str(root))
    assert [r.rel_path for r in inventory.checksum_lists(files).collect()] == ["md5sum.txt"]
    assert [r.rel_path for r in inventory.lists_by_depth(files).collect()] == ["md5sum.txt", "a/b/md5sum.txt"]
    with pytest.raises(ValueError):
        inventory.checksum_lists(files.filter("name = 'x.fna'"))


def test_repair_after_verification(spark, tmp_path):
    make_tree(tmp_path / "data")
    verification = audit.verify_tree(spark, str(tmp_path / "data")).files
    cached = spark.createDataFrame([("GCA_000000002.1.fna", "/c/GCA_000000002.1.fna")], "name STRING, path STRING")
    plan = audit.plan_repair(verification, str(tmp_path / "data"), None, cached)
    assert {(r.original_path, r.status) for r in plan.tasks.collect()} == {
        ("t1/GCA_000000002.1.fna", "DOWNLOADED"), ("t2/gone.fna", "SKIPPED_NO_ACCESSION"),
    }
    again = audit.plan_repair(verification, str(tmp_path / "data"), plan.tasks, cached.limit(0))
    assert {(r.original_path, r.status) for r in again.tasks.collect()} == {(r.original_path, r.status) for r in plan.tasks.collect()}
    run = document_sinks.RepairRun("run1", "/data", datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 12, 0, 45))
    assert run.duration() == "45s"
    document_sinks.write_repair_reports(plan.failed, plan.tasks, str(tmp_path / "reports"), run)
    report = [r.value for r in spark.read.text(str(tmp_path / "reports" / "files")).collect()]
    assert "INITIALLY FAILED FILES (2 files)" in report and "No files were successfully fixed." in report


def test_unreadable_files_become_rows(spark, tmp_path):
    df = spark.createDataFrame([(str(tmp_path / "none"),)], "path STRING")
    row = hash_files(df).first()
    assert row.computed_hash is None and row.error.startswith("I/O error")


def test_package_lists(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as archive:
        archive.writestr("b/md5sum.txt", "x")
        archive.writestr("a/md5sum.txt", f"# c\n{EMPTY}  data/x.fna\n{EMPTY} *y\\z.fna\n")
    paths = spark.createDataFrame([(str(tmp_path / "p.zip"),)], "path STRING")
    assert [(r.member, r.file_path) for r in archives.read_package_checksums(paths).orderBy("line_no").collect()] == [
        ("a/md5sum.txt", "data/x.fna"), ("a/md5sum.txt", "y/z.fna"),
    ]


ARTIFACTS = "batch_num BIGINT, accession STRING, filename STRING, expected_md5 STRING"


def run_again(path, batch):
    """Forget that a batch was done, as after a lost driver."""
    commits_folder = Path(path) / "_checkpoint" / "commits"
    (commits_folder / str(batch)).rename(Path(path) / f"taken-away-{batch}")
    (commits_folder / f".{batch}.crc").rename(Path(path) / f"taken-away-{batch}-crc")


def test_commit_replay_gives_the_same_manifest(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def send(rows):
        if rows:
            spark.createDataFrame(rows, ARTIFACTS).write.mode("append").parquet(source)
        stream = stream_of(spark, source, spark.createDataFrame([], ARTIFACTS).schema)
        commits.commit_artifacts(stream, path, availableNow=True).awaitTermination()
        return sorted((r.filename, r.expected_md5) for r in commits.manifest_of(spark, path).collect())

    assert send([(1, "A", "a", "1"), (1, "B", "b", "1")]) == [("a", "1"), ("b", "1")]
    second = send([(2, "A", "a", "2"), (2, "C", "c", "1"), (3, "D", "d", "1"), (3, "A", "a", "1")])
    assert second == [("a", "1"), ("b", "1"), ("d", "1")]
    assert {r.accession for r in commits.committed(spark, f"{path}/completed").collect()} == {"A", "B", "D"}
    assert [r.filename for r in commits.committed(spark, f"{path}/conflicts").collect()] == ["a"]
    run_again(path, 1)
    assert send([]) == second


def test_manifest_over_many_batches_and_sessions(spark, tmp_path):
    """The table is found again by a session that does not know it, and joined without moving its rows."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(6):
        spark.createDataFrame([(i, f"A{i}", f"f{i}", str(i)), (i, "A", "same", "0")], ARTIFACTS).coalesce(1).write.mode("append").parquet(source)
        if i in (3, 5):
            spark.sql(f"DROP TABLE IF EXISTS {commits.manifest_table(spark, path)}")
            stream = stream_of(spark, source, spark.createDataFrame([], ARTIFACTS).schema, files_per_batch=1)
            commits.commit_artifacts(stream, path, availableNow=True).awaitTermination()
    want = {(f"f{i}", str(i), f"A{i}", i) for i in range(6)} | {("same", "0", "A", 0)}
    found = commits.manifest_of(spark, path)
    assert {(r.filename, r.expected_md5, r.accession, r.batch_num) for r in found.collect()} == want
    old = found.groupBy("filename").agg(F.max("expected_md5"))
    assert "Exchange" not in old._jdf.queryExecution().executedPlan().toString()


def test_chain_of_batches_by_pointer_jumping(spark, monkeypatch):
    """Ten thousand batches, each against the one before it, are settled in rounds that double."""
    rounds = []
    real = manifest.materialize
    monkeypatch.setattr(manifest, "materialize", lambda df, name="step", by=None: rounds.append(name) or real(df, name, by))
    n = 10_000
    number = F.col("id")
    rows = spark.range(n).select(
        number.alias("batch_num"), F.explode(F.array(number, number + 1)).alias("name"), number.cast("string").alias("expected_md5")
    ).select("batch_num", F.lit("A").alias("accession"), F.col("name").cast("string").alias("filename"), "expected_md5")
    empty = spark.createDataFrame([], "filename STRING, expected_md5 STRING")
    judged = manifest.judge_batches(empty, rows).groupBy("batch_num").agg(F.bool_and("batch_ok").alias("ok"))
    assert judged.filter("ok <> (batch_num % 2 = 0)").isEmpty() and judged.count() == n
    assert rounds.count("chains") <= 16 and rounds.count("verdicts") == 1


def in_turn(rows):
    """Batches one after the other."""
    kept, good = {}, {}
    for batch in sorted({r[0] for r in rows}):
        own = {}
        ok = all(own.setdefault(f, m) == m and kept.get(f, m) == m for b, _, f, m in rows if b == batch)
        good[batch] = ok
        if ok:
            kept.update(own)
    return good


def test_batches_as_if_one_after_the_other(spark):
    rng = random.Random(5)
    for names in (3, 12, 40):
        rows = [(rng.randrange(30), "A", f"f{rng.randrange(names)}", str(rng.randrange(2))) for _ in range(60)]
        judged = manifest.judge_batches(
            spark.createDataFrame([], "filename STRING, expected_md5 STRING"), spark.createDataFrame(rows, ARTIFACTS)
        )
        assert {r.batch_num: r.batch_ok for r in judged.collect()} == in_turn(rows)


def test_run_folders_go_at_the_end(spark):
    root = Path(workspace.shared_folder(spark))
    with workspace.run_folder(spark) as folder:
        assert workspace.materialize(spark.range(3)).count() == 3
        assert Path(folder).exists() and Path(folder).parent == root
    assert not Path(folder).exists()
    assert not str(root).startswith(tempfile.gettempdir())


def lines_frame(spark, number):
    return spark.range(number).select(F.concat(F.lit("line "), F.repeat(F.lit("é"), (F.col("id") % 7).cast("int")), "id").alias("line"), (-F.col("id")).alias("place"))


def test_one_file_in_one_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(single_file, "WRITE_BYTES", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = str(tmp_path / "deep" / "list.txt")
    rows = lines_frame(spark, 5000).repartition(7)
    index = single_file.write_lines_file(rows, path, ["place"])
    want = [r.line for r in rows.orderBy("place").collect()]
    assert Path(path).read_text().splitlines() == want and index.count() > 1
    read = single_file.read_text_file(spark, path, index).orderBy("part", "line_no").collect()
    assert [r.line for r in read] == want
    assert single_file.write_lines_file(rows.limit(0), path, ["place"]).count() == 0 and Path(path).read_text() == ""
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError, match="mounted"):
        single_file.write_lines_file(rows, "s3://bucket/list.txt", ["place"])


def test_an_aborted_file_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "list.txt")
    single_file.write_lines_file(lines_frame(spark, 10), path, ["place"])
    old = Path(path).read_text()
    broken = lines_frame(spark, 10).withColumn("line", F.when(F.col("place") == -5, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        single_file.write_lines_file(broken, path, ["place"])
    assert Path(path).read_text() == old and [p.name for p in tmp_path.iterdir()] == ["list.txt"]


def test_whole_documents_are_json(spark, tmp_path):
    manifest_path, progress_path, task_path = (str(tmp_path / n) for n in ("m.json", "p.json", "t.json"))
    rows = [("A", "genome", f'n"{i}\n.fna', "0" * 32, "x", None if i % 2 else "then") for i in range(30)]
    fields = "accession STRING, include_type STRING, filename STRING, expected_md5 STRING, checksum_source STRING, committed_at STRING"
    document_sinks.write_manifest_document(spark.createDataFrame(rows, fields), manifest_path, "now")
    found = json.loads(Path(manifest_path).read_text())
    assert found["schema_version"] == 1 and list(found["artifacts"]) == sorted(r[2] for r in rows)
    assert {a["committed_at"] for a in found["artifacts"].values()} == {"now", "then"}
    states = spark.createDataFrame([("b", "failed"), ("c", "completed"), ("a", "completed"), ("a", "completed")], "item STRING, state STRING")
    for df, done, failed in ((states, ["a", "c"], ["b"]), (states.limit(0), [], [])):
        document_sinks.write_progress_document(df, progress_path, 1.5, 2.5)
        assert json.loads(Path(progress_path).read_text()) == {"completed_taxa": done, "failed_taxa": failed, "start_time": 1.5, "last_update": 2.5}
    tasks = spark.createDataFrame([("t2", "FIXED"), ("t1", "STILL_FAILED")], "task_id STRING, status STRING")
    document_sinks.write_task_document(tasks, task_path, "r", "/d", "c", "u")
    found = json.loads(Path(task_path).read_text())
    assert list(found["tasks"]) == ["t1", "t2"] and found["summary"]["fixed"] == 1 and found["run_id"] == "r"


def test_backup_before_the_first_import(spark, tmp_path):
    text = f"# old\n{EMPTY}  GCA_1.1.fna\n{EMPTY}  gone.fna\n"
    (tmp_path / "md5sum.txt").write_text(text)
    (tmp_path / "GCA_1.1.fna").write_text("")
    outputs = inventory.list_tree(spark, str(tmp_path))
    nothing = spark.createDataFrame([], "filename STRING")
    backup = tmp_path / "md5sum.txt.pre_manifest_migration.bak"
    kept = lambda: "".join(p.read_text() for p in sorted(backup.glob("part-*")))
    assert audit.import_checksum_list(spark, str(tmp_path), spark.createDataFrame([("x",)], "filename STRING"), outputs).count() == 0
    assert not backup.exists()
    rows = audit.import_checksum_list(spark, str(tmp_path), nothing, outputs).collect()
    assert [(r.filename, r.accession) for r in rows] == [("GCA_1.1.fna", "GCA_1.1")] and kept() == text
    (tmp_path / "md5sum.txt").write_text(f"{EMPTY}  GCA_1.1.fna\n")
    assert audit.import_checksum_list(spark, str(tmp_path), nothing, outputs).count() == 1 and kept() == text


def test_a_huge_folder_is_listed_in_shares(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}é").write_text("x" * (i % 5))
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "g").write_text("y")
    want = {(f"f{i}é", i % 5) for i in range(300)} | {("below/g", 1)}
    for limit in (1, 50, 1000):
        found = inventory.list_tree(spark, str(tmp_path), shared_from=limit).collect()
        assert len(found) == 301 and {(r.rel_path, r.size) for r in found} == want


def test_member_lines(spark, tmp_path):
    for name in ("p.zip", "q.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for i in range(5):
                archive.writestr(f"d/{i}.txt", "".join(f"{name} {i} {k}\r\n" for k in range(i)))
    members = archives.list_members(inventory.list_tree(spark, str(tmp_path)))
    assert members.count() == 10
    found = archives.member_lines(members.filter("member <> 'd/4.txt'")).collect()
    assert sorted((r.value, r.line_no) for r in found) == sorted((f"{n} {i} {k}", k + 1) for n in ("p.zip", "q.zip") for i in range(4) for k in range(i))


def test_folders_that_cannot_be_listed_become_rows(spark, tmp_path, monkeypatch):
    rows = list(inventory._entries(str(tmp_path / "gone")))
    assert len(rows) == 1 and rows[0][4].startswith("I/O error")
    assert list(inventory._entries(f"file://{tmp_path}/gone"))[0][4].startswith("I/O error")


def levels_after(spark, tmp_path, parts, **how):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "entity STRING, seq BIGINT, fraction DOUBLE, note INT"
    for rows in parts:
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_of(spark, source, spark.createDataFrame([], schema).schema)
        if how:
            stream = stream.withColumn("at", F.timestamp_seconds("seq"))
        track_levels(stream, path, "entity", [F.col("seq")], F.col("fraction"), availableNow=True, **how).awaitTermination()
    return spark.read.parquet(f"{path}/levels").collect()


def test_levels_carry_over_batches(spark, tmp_path):
    big = 2**53 + 1
    parts = [[("a", 1, 0.5, None), ("a", 2, 0.19, 1), ("b", 1, 0.01, 2)], [("a", 3, 0.21, 3)], [("a", 4, 0.23, 4), ("b", big, 0.06, 5)]]
    found = levels_after(spark, tmp_path, parts)
    assert {(r.entity, r.seq): (r.level, r.note) for r in found} == {
        ("a", 1): ("normal", None), ("a", 2): ("warning", 1), ("a", 3): ("warning", 3), ("a", 4): ("normal", 4),
        ("b", 1): ("paused", 2), ("b", big): ("paused", 5),
    }
    # A batch that runs again is written once.
    run_again(str(tmp_path / "out"), 2)
    assert sorted(map(str, levels_after(spark, tmp_path, [[]]))) == sorted(map(str, found))


def test_late_measurements_have_no_level(spark, tmp_path):
    parts = [[("a", 100, 0.5, 0), ("b", 10, 0.5, 0)], [("a", 105, 0.01, 0), ("a", 99, 0.01, 0), ("b", 89, 0.01, 0), ("b", 95, 0.15, 0)], [("a", 106, 0.5, 0)]]
    found = levels_after(spark, tmp_path, parts, event_time="at", delay="10 seconds")
    assert {(r.entity, r.seq): (r.level, r.late) for r in found} == {
        ("a", 100): ("normal", False), ("b", 10): ("normal", False), ("a", 105): ("paused", False), ("a", 99): (None, True),
        ("b", 89): (None, True), ("b", 95): ("warning", False), ("a", 106): ("normal", False),
    }


def test_task_events_out_of_order_late_and_twice(spark, tmp_path):
    """Within the delay order does not matter; what comes later, twice or makes no sense is kept apart."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "task_id STRING, event_id BIGINT, second BIGINT, kind STRING, status STRING, accession_id STRING, fix_holds BOOLEAN"

    def send(*events):
        rows = [("t", i, at, kind, status, "A", False) for i, at, kind, status in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_of(spark, source, spark.createDataFrame([], schema).schema).withColumn("at", F.timestamp_seconds("second"))
        track_tasks(stream, path, "10 seconds", availableNow=True).awaitTermination()
        sections = spark.read.parquet(f"{path}/sections")
        state = current_states(sections).first()
        apart = sorted((r.section, r.event_id) for r in sections.filter("section <> 'state'").collect())
        return (state.status, state.attempts, state.n_events, state.n_illegal), apart

    assert send((3, 103, "retry", None), (1, 101, "update", "STILL_FAILED"))[0] == ("DOWNLOAD_QUEUED", 1, 2, 0)
    # An update before the retry that makes it void, the retry once more, and a kind that does not exist.
    state, apart = send((2, 102, "update", "VERIFYING"), (3, 103, "retry", None), (4, 104, "pause", None))
    assert state == ("VERIFYING", 0, 4, 1) and apart == [("illegal", 4), ("repeated", 3)]
    assert send((5, 200, "recover", None))[0] == ("ORGANIZED", 0, 5, 1)
    state, apart = send((6, 105, "update", "FIXED"), (7, 195, "update", "FIXED"))
    assert state == ("DOWNLOAD_QUEUED", 0, 6, 1) and ("late", 6) in apart




def _json_tasks(n):
    fields = [f.split(":")[0] for f in documents.TASK_FIELDS.split(", ")]
    given = {"task_id": "concat('t', id)", "status": "'FIXED'", "original_path": "concat('a\"', id, '\\\\n{')", "attempts": "id"}
    return [f"{given.get(f, 'cast(null as string)')} as {f}" for f in fields], n


def test_no_task_holds_a_document_of_tasks(spark, tmp_path, monkeypatch):
    columns, n = _json_tasks(3000)
    rows = spark.range(n).selectExpr(*columns)
    rows = rows.union(rows.filter("attempts % 500 = 0"))
    path = str(tmp_path / "tasks")
    for _ in range(2):
        document_sinks.write_task_state(rows, path, "run", "/d", "a", "b", documents=2, fingerprint={"list": "x"})
    texts = [json.loads(p.read_text()) for p in sorted((tmp_path / "tasks").glob("part*"))]
    assert len(texts) == 2 and sum(len(t["tasks"]) for t in texts) == n
    assert all(list(t["tasks"]) == sorted(t["tasks"]) for t in texts)
    # Many tasks read one document, each a share of its lines.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = documents.read_task_state(spark, path)
        assert found.rdd.getNumPartitions() > 4
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
        heads = documents.read_task_heads(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(heads) == 2 and {h.summary["total"] for h in heads} == {n + 6} and {h.input_fingerprint["list"] for h in heads} == {"x"}


def test_documents_of_any_form_are_read_together(spark, tmp_path):
    head = '{"schema_version": 1, "run_id": "%s", "tasks": {'
    entries = ['"a": {"task_id": "a", "attempts": 1}', '"b": {"task_id": "b", "attempts": 2}']
    whole = {"schema_version": 1, "run_id": "indented", "tasks": {"c": {"task_id": "c"}}}
    texts = {
        "lines": head % "lines" + "\n" + ",\n".join(entries) + "\n}}\n",
        "empty": head % "empty" + "\n\n}}\n",
        "indented": json.dumps(whole, indent=1),
        "cut": head % "cut" + "\n" + entries[0] + ",\n",
        "no comma": head % "comma" + "\n" + "\n".join([*entries, entries[0] + ","]) + "\n}}\n",
        "bad type": head % "type" + '\n"a": {"task_id": "a", "attempts": "x"}\n}}\n',
        "none": "",
    }
    (tmp_path / "d").mkdir()
    for name, text in texts.items():
        (tmp_path / "d" / f"{name}.json").write_text(text)
    assert sorted(r.task_id for r in documents.read_task_state(spark, str(tmp_path / "d")).collect()) == ["a", "b", "c"]
    assert sorted(r.run_id for r in documents.read_task_heads(spark, str(tmp_path / "d")).collect()) == ["empty", "indented", "lines", "type"]
    with pytest.raises(Exception, match="Unsupported task state version"):
        documents.read_task_state(spark, str(tmp_path / "d" / "lines.json"), version=2).collect()


def test_very_many_folders_are_written_and_read_by_tasks(spark, tmp_path):
    names = ["a_1", "b=c/d%", "é+ x", None, "z"]
    rows = spark.createDataFrame([(names[i % 5], i, f"l{i}" if i % 7 else None) for i in range(500)], "file STRING, no INT, line STRING")
    path = str(tmp_path / "o")
    for _ in range(2):
        write_lines(rows, path, ["no"], folder="file")
    assert all(p.suffix == ".txt" for p in (tmp_path / "o").rglob("*") if p.is_file())
    wanted = sorted((names[i % 5] or "", f"l{i}" if i % 7 else "") for i in range(500))
    assert sorted((r.file or "", r.value) for r in spark.read.text(path).collect()) == wanted
    found = lines.read_folders(spark, path, "file").collect()
    assert sorted((r.file or "", r.value) for r in found) == wanted
    own = [r.value for r in sorted(found, key=lambda r: tuple(r.line)) if r.file == "z"]
    assert own == [f"l{i}" if i % 7 else "" for i in range(4, 500, 5)]


def test_task_state_takes_and_gives_rows():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from cladeledger.streaming.tasks import TaskState

    kept = []
    state = SimpleNamespace(get=lambda: kept[-1] if kept else None, update=kept.append)
    machine = TaskState(["PENDING", "FIXED"], "PENDING", True)
    machine.init(SimpleNamespace(getValueState=lambda name, schema: state))
    event = lambda at, i, nexts, legal=True: Row(task_id="t", event_id=i, at_millis=at, f=json.dumps([nexts, [0, 1]]), legal=legal)
    timer = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    first = list(machine.handleInputRows(("t",), iter([event(5, 2, [1, 1]), event(3, 1, [0, 0]), event(5, 2, [1, 1])]), timer(0)))
    assert [(r.section, r.event_id, r.status, r.attempts, r.n_events) for r in first] == [("repeated", 2, None, None, None), ("state", None, "FIXED", 0, 2)]
    second = list(machine.handleInputRows(("t",), iter([event(1, 9, [0, 0]), event(9, 3, [0, 0], False)]), timer(4)))
    assert [(r.section, r.event_id, r.status, r.attempts, r.n_illegal) for r in second] == [("late", 9, None, None, None), ("illegal", 3, None, None, None), ("state", None, "PENDING", 1, 1)]
