"""Operators against plain Python on small inputs, also with limits that force the spread-out paths."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeledger.operators import dedup, hierarchy, levels, manifest, packing, repair, reports, resume, task_machine
from cladeledger.ordering import with_last_known, with_row_number
from cladeledger.plans.split import plan_split

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def first_fit(items, capacity):
    bins, place = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        if size > capacity:
            continue
        for i, used in enumerate(bins):
            if used + size <= capacity:
                bins[i] += size
                place[name] = i + 1
                break
        else:
            bins.append(size)
            place[name] = len(bins)
    return place


@FEW
@given(
    sizes=st.lists(st.integers(1, 60), min_size=1, max_size=60), chunk=st.sampled_from([5, 16, 1000]), max_sizes=st.sampled_from([0, 100])
)
def test_packing_is_first_fit_decreasing(spark, sizes, chunk, max_sizes):
    items = list(enumerate(sizes))
    df = spark.createDataFrame(items, "tax_id BIGINT, size_bp BIGINT")
    rows = packing.pack(df, 50, chunk_rows=chunk, max_sizes=max_sizes).collect()
    assert len(rows) == len(items)
    assert {r.tax_id: r.bin for r in rows if r.bin is not None} == first_fit(items, 50)
    assert {r.tax_id for r in rows if r.bin is None} == {i for i, s in items if s > 50}


@pytest.mark.parametrize("chunk, max_sizes", [(40, 0), (40, 95), (40, 1000), (10_000, 0)])
def test_packing_per_key_with_a_hot_key(spark, chunk, max_sizes):
    """All hot keys in waves, some of them, none of them, and no hot keys; one key is null."""
    rng = random.Random(1)
    items = [(i, "hot" if i % 3 else (None if i % 9 else "k0"), rng.randint(1, 120)) for i in range(600)]
    df = spark.createDataFrame(items, "accession BIGINT, taxon_id STRING, sequence_length BIGINT")
    rows = packing.pack_all(df.na.fill("none"), 100, "sequence_length", "accession", ["taxon_id"], chunk, max_sizes).collect()
    plain = packing.pack(df, 100, "sequence_length", "accession", ["taxon_id"], chunk, max_sizes).collect()
    assert {r.accession: r.bin for r in plain if r.taxon_id is None} == {
        r.accession: r.bin if r.sequence_length <= 100 else None for r in rows if r.taxon_id == "none"
    }
    items = [(i, k or "none", n) for i, k, n in items]
    for key in {k for _, k, _ in items}:
        members = [(i, s) for i, k, s in items if k == key]
        expected = first_fit(members, 100)
        last = max(expected.values(), default=0)
        over = sorted(i for i, s in members if s > 100)
        expected.update({i: last + n for n, i in enumerate(over, 1)})
        assert {r.accession: r.bin for r in rows if r.taxon_id == key} == expected


def test_packing_keeps_rows_with_equal_names(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("b", 1, 7)], "accession STRING, taxon_id INT, sequence_length BIGINT")
    assert packing.pack_all(df, 10, "sequence_length", "accession", ["taxon_id"]).count() == 3


def reachable(edges, start):
    found, todo = {start}, [start]
    while todo:
        node = todo.pop()
        for parent, child in edges:
            if parent == node and child not in found:
                found.add(child)
                todo.append(child)
    return found


@FEW
@given(edges=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_closure_equals_search_and_ends_on_cycles(spark, edges):
    pairs = spark.createDataFrame(edges, "parent BIGINT, child BIGINT")
    seeds = spark.createDataFrame([(i,) for i in range(10)], "tax_id BIGINT")
    rows = hierarchy.closure(pairs, seeds).collect()
    expected = {(a, d) for a in range(10) for d in reachable(edges, a)}
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_closure_of_single_parent_cycles(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6), (7, 7)]
    pairs = spark.createDataFrame(edges, "parent BIGINT, child BIGINT")
    seeds = spark.createDataFrame([(i,) for i in range(8)], "tax_id BIGINT")
    rows = hierarchy.closure(pairs, seeds).collect()
    expected = {(a, d) for a in range(8) for d in reachable(edges, a)}
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_closure_and_roll_up_of_a_long_chain(spark, monkeypatch):
    """4,096 nodes in a row: rounds follow the logarithm, and the roll-up writes no pairs."""
    written = []
    real = hierarchy.materialize
    monkeypatch.setattr(hierarchy, "materialize", lambda df, name="step", by=None: written.append(name) or real(df, name, by))
    n = 4096
    links = spark.range(1, n).select((F.col("id") - 1).alias("parent"), F.col("id").alias("child"))
    seeds = spark.createDataFrame([(0,), (4000,)], "tax_id BIGINT")
    pairs = hierarchy.closure(links, seeds)
    assert pairs.groupBy("ancestor").count().orderBy("ancestor").collect() == [(0, n), (4000, n - 4000)]
    assert written.count("closure") <= 13 and written.count("jumps") <= 13
    genomes = spark.range(n).filter("id % 3 = 0").select(F.lit("GCA_1").alias("accession"), F.col("id").alias("tax_id"), F.lit(2).cast("bigint").alias("sequence_length"))
    rolled = hierarchy.roll_up_forest(hierarchy.jumps(links), spark.range(n).withColumnRenamed("id", "tax_id"), genomes)
    below = 3 * F.floor(F.lit(n - 1) / 3) - F.ceil(F.col("tax_id") / 3) * 3
    wrong = rolled.filter((F.col("size_bp") != 2 * (below / 3 + 1)) | (F.col("has_direct") != (F.col("tax_id") % 3 == 0)))
    assert rolled.count() == n and wrong.isEmpty()


def test_roll_up_of_a_forest_equals_the_closure(spark):
    rng = random.Random(3)
    parents = {i: rng.randrange(i) for i in range(1, 60) if i % 11}
    links = spark.createDataFrame([(p, c) for c, p in parents.items()], "parent BIGINT, child BIGINT")
    nodes = spark.createDataFrame([(i,) for i in range(60)], "tax_id BIGINT")
    genomes = spark.createDataFrame([("GCA", rng.randrange(70), rng.randrange(100)) for _ in range(80)] + [("GCA", None, 1)], "accession STRING, tax_id BIGINT, sequence_length BIGINT")
    want = hierarchy.roll_up(hierarchy.closure(links, nodes), genomes)
    got = hierarchy.roll_up_forest(hierarchy.jumps(links), nodes, genomes)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    for more in ([(58, 1)], [(59, 0), (0, 59)]):
        tangled = links.union(spark.createDataFrame(more, links.schema))
        with pytest.raises(ValueError):
            hierarchy.roll_up_forest(hierarchy.jumps(tangled), nodes, genomes)


def test_source_filter_reaches_the_files(spark, tmp_path):
    spark.createDataFrame([("GCF_1", 1), ("GCA_2", 2)], "accession STRING, tax_id BIGINT").write.parquet(str(tmp_path / "g"))
    found = hierarchy.filter_source(spark.read.parquet(str(tmp_path / "g")), "refseq").select("accession")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(accession,GCF_)" in plan and "tax_id" not in plan


def test_unknown_source_is_rejected(spark):
    with pytest.raises(ValueError):
        hierarchy.filter_source(spark.createDataFrame([("GCF_1",)], "accession STRING"), "other")


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"e{i % 5}", i, rng.choice([None, i]), rng.random()) for i in range(400)]
    return rows, spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT, fraction DOUBLE")


@pytest.mark.parametrize("limit", [10, 100, 100_000])
def test_row_numbers(series, limit):
    rows, df = series
    found = {r.seq: r.n for r in with_row_number(df, ["k"], [F.col("seq")], "n", limit).collect()}
    seen, expected = {}, {}
    for key, seq, *_ in rows:
        seen[key] = seen.get(key, 0) + 1
        expected[seq] = seen[key]
    assert found == expected


def test_missing_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(3)], "k STRING, seq INT")
    rows = with_row_number(df, ["k"], [F.col("seq")], "n", 10).collect()
    assert len(rows) == 23 and all(r.n == r.seq + 1 for r in rows)


def test_global_row_numbers(series):
    _, df = series
    assert {r.seq: r.n for r in with_row_number(df, [], [F.col("seq")], "n").collect()} == {i: i + 1 for i in range(400)}


@pytest.mark.parametrize("limit", [10, 100, 100_000])
def test_last_known_values(series, limit):
    rows, df = series
    found = {r.seq: r.last for r in with_last_known(df, ["k"], [F.col("seq")], {"last": F.col("v")}, limit).collect()}
    state, expected = {}, {}
    for key, seq, value, _ in rows:
        state[key] = state.get(key) if value is None else value
        expected[seq] = state[key]
    assert found == expected


def level(fraction):
    return 3 if fraction < 0.05 else 2 if fraction < 0.10 else 1 if fraction < 0.20 else 0


def python_levels(rows):
    state, result = {}, {}
    for key, seq, _, fraction in rows:
        now, plain, reduced = state.get(key, 0), level(fraction), level(fraction - 0.02)
        state[key] = plain if plain >= now else reduced if reduced < now else now
        result[seq] = state[key]
    return result


@pytest.mark.parametrize("limit", [10, 100, 100_000])
def test_levels_equal_the_step_rule(spark, series, limit):
    rows, _ = series
    rows = [(k, s, v, f * 0.3) for k, s, v, f in rows]
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT, fraction DOUBLE")
    found = levels.hysteresis_levels(df, ["k"], [F.col("seq")], F.col("fraction"), max_group_rows=limit)
    assert {r.seq: r.level_rank for r in found.collect()} == python_levels(rows)


def test_level_example(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([0.50, 0.19, 0.21, 0.23])], "k STRING, seq INT, f DOUBLE")
    found = levels.hysteresis_levels(df, ["k"], [F.col("seq")], F.col("f")).orderBy("seq")
    assert [r.level for r in found.collect()] == ["normal", "warning", "warning", "normal"]


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "z")], "k STRING, pos INT, v STRING")
    first = dedup.first_wins(df, ["k"], F.col("pos"), "copies").orderBy("k").collect()
    assert [tuple(r) for r in first] == [("a", 1, None, 2), ("b", 1, "z", 1)]
    assert [r.v for r in dedup.last_wins(df, ["k"], F.col("pos")).orderBy("k").collect()] == ["x", "z"]


def test_runs_of_equal_items_fill_runs_of_bins():
    """The plan from sizes and counts against first fit item by item."""
    rng = random.Random(2)
    for turn in range(300):
        capacity = rng.randint(1, 60)
        sizes = sorted(rng.sample(range(turn % 3 > 0, capacity + 1), min(rng.randint(1, 12), capacity)), reverse=True)
        counts = [rng.randint(1, 30) for _ in sizes]
        flat = [n for n, c in zip(sizes, counts) for _ in range(c)]
        want, _ = packing.fill_bins(np.array(flat), np.empty(0, np.int64), capacity, len(flat))
        plan = packing.plan_runs(np.array(sizes), np.array(counts), capacity)
        got = []
        for (run, start, first, each), after in zip(plan, [*plan[1:], (None, 0, 0, 0)]):
            stop = after[1] if after[0] == run else counts[run]
            got += [first + i // each for i in range(stop - start)]
        assert got == want


def test_a_million_items_of_one_key_without_a_wave(spark, monkeypatch):
    def no_waves(*_):
        raise AssertionError("waves")

    monkeypatch.setattr(packing, "_place_in_waves", no_waves)
    items = spark.range(1_000_000).select(
        F.col("id").alias("tax_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) * 997 + 1).alias("size_bp"), F.lit("one").alias("k")
    )
    packed = packing.pack(items, 1_500_000, keys=["k"])
    bins = packed.groupBy("bin").agg(F.sum("size_bp").alias("used")).agg(F.max("used"), F.count("*"), F.sum("used"), F.max("bin")).first()
    assert bins[0] <= 1_500_000 and bins[1] == bins[3] and packed.filter("bin IS NULL").isEmpty()
    assert bins[1] <= bins[2] / 1_500_000 * 1.01 + 1


def test_items_without_a_size_are_kept(spark):
    df = spark.createDataFrame([("t", "a", 5), ("t", "b", None), ("t", "c", 50)], "taxon_id STRING, accession STRING, sequence_length BIGINT")
    assert {(r.accession, r.bin) for r in packing.pack(df, 10, "sequence_length", "accession").collect()} == {("a", 1), ("b", None), ("c", None)}
    every = packing.pack_all(df, 10, "sequence_length", "accession", ["taxon_id"])
    assert {(r.accession, r.bin) for r in every.collect()} == {("a", 1), ("b", None), ("c", 2)}


def test_packing_plan_does_not_grow_with_waves(spark):
    """One scan reads all waves, and ties go the same way on every path."""
    df = spark.range(400).select(F.col("id").alias("tax_id"), (F.col("id") % 7 + 3).alias("size_bp"), F.lit("x").alias("name"))
    plans = []
    for chunk in (20, 100):
        packed = packing.pack(df, 20, chunk_rows=chunk, max_sizes=0)
        plans.append(packed._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        assert {tuple(r) for r in packed.collect()} == {tuple(r) for r in packing.pack(df, 20).collect()}
        named = df.select(F.lit(1).cast("bigint").alias("tax_id"), "size_bp", F.col("tax_id").cast("string").alias("name"))
        assert {tuple(r) for r in packing.pack(named, 20, chunk_rows=chunk).collect()} == {tuple(r) for r in packing.pack(named, 20).collect()}
    assert plans[0] == plans[1] <= 4


def test_completeness_takes_one_exchange(spark):
    accessions = spark.createDataFrame([("A.1",), ("B.1",), ("B.1",), ("C.1",)], "accession STRING")
    files = spark.createDataFrame([("A.1.fna",), ("A.1.faa",), ("B.1.fna",), ("C.1.rna.fna",), ("x",)], "name STRING")
    trusted = spark.createDataFrame([("A.1.fna", "1"), ("A.1.faa", "1"), ("B.1.fna", "1"), ("B.1.faa", ""), ("C.1.rna.fna", "2")], "filename STRING, expected_md5 STRING")
    done = resume.completeness(accessions, files, trusted, ["genome", "protein"])
    assert {tuple(r) for r in done.collect()} == {("A.1", 2, 2, True), ("B.1", 4, 2, False), ("C.1", 2, 0, False)}
    assert done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_manifest_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "filename STRING, expected_md5 STRING")
    batch = spark.createDataFrame([("b", "2"), ("c", "3"), ("a", "9"), ("d", "4"), ("d", "5")], "filename STRING, expected_md5 STRING")
    actions = {r.filename: r.action for r in manifest.classify_merge(old, batch).collect()}
    assert actions == {"a": "conflict", "b": "unchanged", "c": "insert", "d": "conflict"}
    once = manifest.merge(old, batch)
    assert {tuple(r) for r in once.collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert {tuple(r) for r in manifest.merge(once, batch).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}


def test_conflicting_batches_fail_whole(spark):
    old = spark.createDataFrame([("a", "1")], "filename STRING, expected_md5 STRING")
    rows = [(1, "a", "2"), (1, "x", "1"), (2, "b", "1"), (3, "b", "2"), (3, "c", "1"), (4, "x", "9")]
    judged = manifest.judge_batches(old, spark.createDataFrame(rows, "batch_num BIGINT, filename STRING, expected_md5 STRING"))
    assert {r.batch_num: r.batch_ok for r in judged.collect()} == {1: False, 2: True, 3: False, 4: True}


def test_a_failed_batch_claims_nothing(spark):
    """Against judging the batches one after the other."""
    rng = random.Random(4)
    for _ in range(4):
        known = {f"n{i}": str(rng.randrange(2)) for i in range(3)}
        rows = [(b, f"n{rng.randrange(14)}", str(rng.randrange(2))) for b in range(12) for _ in range(rng.randrange(1, 4))]
        claims, want = dict(known), {}
        for b in range(12):
            own = [(n, m) for x, n, m in rows if x == b]
            want[b] = len(dict(own)) == len(set(own)) and all(claims.get(n, m) == m for n, m in own)
            if want[b]:
                claims.update(own)
        old = spark.createDataFrame(list(known.items()), "filename STRING, expected_md5 STRING")
        judged = manifest.judge_batches(old, spark.createDataFrame(rows, "batch_num BIGINT, filename STRING, expected_md5 STRING"))
        assert {r.batch_num: r.batch_ok for r in judged.collect()} == want


def test_recovery_states(spark):
    states = ["PENDING", "DOWNLOADING", "FAILED_RETRYABLE", "ORGANIZING", "VERIFYING", "FIXED", "DOWNLOADED", "FAILED_FATAL"]
    df = spark.createDataFrame([(s, True) for s in states] + [("FIXED", False)], "s STRING, holds BOOLEAN")
    status = repair.recovered_status(F.col("s"), F.lit("GCA_1"), F.col("holds"))
    assert [r[0] for r in df.select(status).collect()] == [
        "DOWNLOAD_QUEUED", "DOWNLOAD_QUEUED", "DOWNLOAD_QUEUED", "DOWNLOADED", "ORGANIZED", "FIXED", "DOWNLOADED",
        "FAILED_FATAL", "DOWNLOAD_QUEUED",
    ]


def test_success_rate_without_downloads(spark):
    rows = [("FIXED", "A")] * 7 + [("STILL_FAILED", "A")] + [("SKIPPED_NO_ACCESSION", None)] * 2
    tasks = spark.createDataFrame(rows, "status STRING, accession_id STRING")
    assert repair.repair_result(tasks).first().success_rate == 87.5
    skipped = tasks.filter("accession_id IS NULL")
    assert repair.repair_result(skipped).first().success_rate == 0.0


def test_top_failures_are_cut_before_the_shuffle(spark):
    kind = F.when(F.col("id") % 100 == 99, "data").otherwise("transient")
    top = reports.top_failures(spark.range(1000).select(kind.alias("error_type"), "id"), [F.col("id")])
    rows = top.collect()
    assert sorted(r.id for r in rows if r.error_type == "transient") == list(range(10))
    assert {(r.error_type, r.n_more) for r in rows} == {("transient", 980), ("data", 0)}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_split_plan_keeps_every_genome(spark):
    nodes = spark.createDataFrame(
        [(1, "Root", "PHYLUM", []), (2, "Abc def", "SPECIES", [1]), (3, "Ghi sp.", "SPECIES", [1]), (4, "strain x", "STRAIN", [2, 1])],
        "tax_id BIGINT, name STRING, rank STRING, parent_ids ARRAY<BIGINT>",
    )
    genomes = spark.createDataFrame(
        [("GCA_1", 2, 10), ("GCA_2", 4, 25), ("GCF_3", 4, 40), ("GCA_4", 3, 20)], "accession STRING, tax_id BIGINT, sequence_length BIGINT"
    )
    plan = plan_split(nodes, genomes, "species", 30e-9)
    assert {(r.tax_id, r.bin, r.size_bp) for r in plan.packed.collect()} == {(2, None, 75), (3, 1, 20)}
    assert {(r.accession, r.bin) for r in plan.accession_bins.collect()} == {("GCA_2", 1), ("GCA_1", 2), ("GCF_3", 3)}
    named = plan_split(nodes, genomes, "species", 1.0, source="genbank", names_only=True)
    assert [(r.tax_id, r.size_bp) for r in named.packed.collect()] == [(2, 35)]


def run_events(events):
    state, attempts, illegal = "PENDING", 0, 0
    for kind, status, accession, holds in events:
        if kind == "update" and status in task_machine.TASK_STATES:
            state = status
        elif kind == "retry":
            if state in ("STILL_FAILED", "FAILED_RETRYABLE"):
                state, attempts = "DOWNLOAD_QUEUED", attempts + 1
        elif kind == "recover":
            if not accession:
                state = state if state in ("FIXED", "SKIPPED_NO_ACCESSION") else "SKIPPED_NO_ACCESSION"
            elif state in ("PENDING", "DOWNLOADING", "FAILED_RETRYABLE") or state == "FIXED" and not holds:
                state = "DOWNLOAD_QUEUED"
            else:
                state = {"ORGANIZING": "DOWNLOADED", "VERIFYING": "ORGANIZED"}.get(state, state)
        else:
            illegal += 1
    return state, attempts, len(events), illegal


@pytest.mark.parametrize("run", [2, 7, 1024])
def test_task_machine_equals_events_one_by_one(spark, run):
    rng = random.Random(9)
    events, by_task = [], {}
    for i in range(600):
        task = "hot" if i % 3 else f"t{rng.randrange(20)}"
        kind = rng.choice(["update", "update", "retry", "recover", "pause", None])
        what = (kind, rng.choice([*task_machine.TASK_STATES, "BROKEN", None]), rng.choice(["A", "A", "", None]), rng.choice([True, False, None]))
        by_task.setdefault(task, []).append(what)
        events.append((task, i, i // 4, *what))
    schema = "task_id STRING, event_id BIGINT, at INT, kind STRING, status STRING, accession_id STRING, fix_holds BOOLEAN"
    df = spark.createDataFrame(events, schema).withColumn("at", F.timestamp_seconds("at"))
    got = task_machine.final_states(df.union(df.filter("event_id % 5 = 0")), run).collect()
    assert {r.task_id: (r.status, r.attempts, r.n_events, r.n_illegal) for r in got} == {t: run_events(e) for t, e in by_task.items()}
    assert task_machine.final_states(df.limit(0), run).count() == 0


def test_ties_do_not_depend_on_the_way(spark):
    rows = [("a", i % 2, i, None if i % 3 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "k STRING, seq INT, id INT, v INT")
    found = [{r.id: r.last for r in with_last_known(df, ["k"], [F.col("seq")], {"last": F.col("v")}, limit).collect()} for limit in (5, 100)]
    assert found[0] == found[1]
