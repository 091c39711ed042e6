"""Queries of the hierarchy, packing, join, aggregate, window and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeledger import fixed_values as fixed
from cladeledger.functions import accessions, checksums, filetypes, space, text
from cladeledger.operators import dedup, hierarchy, integrity, layout, levels, manifest, packing, repair, reports, resume
from cladeledger.ordering import with_row_number
from cladeledger.workload.fixtures import derived, given
from cladeledger.workload.registry import query
from cladeledger.workspace import new_path

# Hierarchy -----------------------------------------------------------------------------------------


def nodes(spark, sf):
    """Taxonomy nodes with the full line of parents for species, direct parents for the others."""
    flat = derived(spark, sf, "taxonomy")
    parents = flat.select(F.col("tax_id").alias("parent"), F.col("parent").alias("grandparent"))
    line = F.filter(F.array("parent", "grandparent"), lambda p: p.isNotNull())
    return flat.join(parents, "parent", "left").select(
        "tax_id", "name", F.col("rnk").alias("rank"), line.cast("array<bigint>").alias("parent_ids")
    )


def genomes(spark, sf):
    return derived(spark, sf, "genomes")


_CLOSURE = (
    "c(ancestor, descendant) as (select tax_id, tax_id from taxonomy"
    " union select c.ancestor, t.tax_id from c join taxonomy t on t.parent = c.descendant)"
)
_SIZES = (
    f"{_CLOSURE}, sizes as (select ancestor as tax_id, cast(sum(sequence_length) as bigint) as size_bp, count(*) as n_genomes,"
    " bool_or(ancestor = descendant) as has_direct, bool_or(ancestor <> descendant) as has_below"
    " from c join genomes g on g.tax_id = c.descendant group by 1)"
)


@query("gr_1_edges", "taxonomy", "select parent, tax_id as child from taxonomy where parent is not null union select p.parent, t.tax_id from taxonomy t join taxonomy p on p.tax_id = t.parent where p.parent is not null")
def _(spark, sf):
    return hierarchy.edges(nodes(spark, sf))


@query("gr_2_closure", "taxonomy", "select ancestor, descendant from c", _CLOSURE)
def _(spark, sf):
    tree = nodes(spark, sf)
    return hierarchy.closure(hierarchy.edges(tree), tree)


@query("gr_2_closure_of_direct_parents", "taxonomy", "select ancestor, descendant from c", _CLOSURE)
def _(spark, sf):
    flat = derived(spark, sf, "taxonomy")
    pairs = flat.filter("parent IS NOT NULL").select("parent", F.col("tax_id").alias("child"))
    return hierarchy.closure(pairs, flat)


@query("se_4_descendant_union", "taxonomy", "select descendant, count(*) as n_ancestors from c group by 1", _CLOSURE)
def _(spark, sf):
    tree = nodes(spark, sf)
    pairs = hierarchy.closure(hierarchy.edges(tree), tree)
    return pairs.groupBy("descendant").agg(F.count("*").alias("n_ancestors"))


@query("gr_3_nodes_at_rank", "taxonomy", "select tax_id, name from taxonomy where rnk = 'GENUS'")
def _(spark, sf):
    return hierarchy.nodes_at_rank(nodes(spark, sf), "genus").select("tax_id", "name")


def pairs_at(spark, sf, rank):
    tree = nodes(spark, sf)
    return tree, hierarchy.closure(hierarchy.edges(tree), hierarchy.nodes_at_rank(tree, rank))


@query("gr_5_roll_up", "taxonomy genomes", "select s.* from sizes s join taxonomy t on t.tax_id = s.tax_id where t.rnk = 'PHYLUM'", _SIZES)
def _(spark, sf):
    _tree, pairs = pairs_at(spark, sf, "PHYLUM")
    return hierarchy.roll_up(pairs, genomes(spark, sf))


@query("gr_5_roll_up_forest", "taxonomy genomes", "select * from sizes", _SIZES)
def _(spark, sf):
    """All nodes of a forest, without the pairs of the closure."""
    flat = derived(spark, sf, "taxonomy")
    links = flat.filter("parent IS NOT NULL").select("parent", F.col("tax_id").alias("child"))
    return hierarchy.roll_up_forest(hierarchy.jumps(links), flat, genomes(spark, sf))


_CHAINS = "t as (select o_orderkey as id, case when o_orderkey % 97 > 0 then o_orderkey - 1 end as parent from orders), c(ancestor, descendant) as (select id, id from t where id % 13 = 0 union select c.ancestor, t.id from c join t on t.parent = c.descendant)"


@query("gr_2_closure_of_long_chains", "", "select ancestor, descendant from c", _CHAINS)
def _(spark, sf):
    """Orders as links of chains, broken where a key is missing or a multiple of 97."""
    key = F.col("o_orderkey").cast("bigint")
    chains = given(spark, sf, "orders").select(key.alias("tax_id"), F.when(key % 97 > 0, key - 1).alias("parent"))
    links = chains.filter("parent IS NOT NULL").select("parent", F.col("tax_id").alias("child"))
    return hierarchy.closure(links, chains.filter("tax_id % 13 = 0"))


def classified(spark, sf):
    flat = derived(spark, sf, "taxonomy")
    genus = flat.filter("rnk = 'GENUS'").select(F.col("tax_id").alias("parent"), F.col("name").alias("genus"))
    entry = F.struct(F.col("genus").alias("name"), F.col("parent").alias("id"))
    empty = F.create_map().cast("map<string,struct<name:string,id:bigint>>")
    classification = F.when(F.col("genus").isNotNull(), F.create_map(F.lit("genus"), entry)).otherwise(empty)
    return flat.join(genus, "parent", "left").select("tax_id", classification.alias("classification"))


@query(
    "fn_18_taxon_at_rank", "taxonomy genomes",
    "select i.tax_id, case when g.rnk = 'GENUS' then g.name else 'unknown_genus' end as taxon_name, case when g.rnk = 'GENUS' then g.tax_id else -1 end as taxon_id"
    " from (select tax_id from taxonomy union all select -5) i left join taxonomy t on t.tax_id = i.tax_id left join taxonomy g on g.tax_id = t.parent",
)
def _(spark, sf):
    tree = classified(spark, sf)
    ids = tree.select("tax_id").unionByName(spark.range(1).select(F.lit(-5).cast("bigint").alias("tax_id")))
    return hierarchy.taxon_at_rank(ids, tree, "Genus")


@query("jn_1_genomes_per_taxon", "genomes", "select tax_id, count(*) as n_genomes, cast(sum(sequence_length) as bigint) as size_bp from genomes group by 1")
def _(spark, sf):
    return hierarchy.genomes_per_taxon(genomes(spark, sf))


@query(
    "jn_2_genomes_below", "taxonomy genomes",
    "select ancestor as taxon_id, accession, g.tax_id, sequence_length from c join genomes g on g.tax_id = c.descendant join taxonomy t on t.tax_id = ancestor where t.rnk = 'GENUS' and accession like 'GCF%'",
    _CLOSURE,
)
def _(spark, sf):
    _tree, pairs = pairs_at(spark, sf, "GENUS")
    found = hierarchy.genomes_below(pairs, hierarchy.filter_source(genomes(spark, sf), "refseq"))
    return found.select("taxon_id", "accession", "tax_id", "sequence_length")


@query(
    "jn_3_descendants_with_genomes", "taxonomy genomes",
    "select ancestor, descendant, t.name from c join taxonomy t on t.tax_id = descendant where ancestor <> descendant and descendant in (select tax_id from genomes)",
    _CLOSURE,
)
def _(spark, sf):
    tree = nodes(spark, sf)
    pairs = hierarchy.closure(hierarchy.edges(tree), tree)
    return hierarchy.descendants_with_genomes(pairs, tree, genomes(spark, sf))


@query(
    "ag_1_rank_counts", "taxonomy",
    "select rnk as rank, count(*) as n_nodes, cast(list_position(['SUPERKINGDOM','KINGDOM','PHYLUM','CLASS','ORDER','FAMILY','GENUS','SPECIES'], rnk) as bigint) as place from taxonomy group by 1",
)
def _(spark, sf):
    return hierarchy.rank_counts(nodes(spark, sf))


@query("ag_2_total_size", "taxonomy genomes", "select tax_id, size_bp from sizes", _SIZES)
def _(spark, sf):
    tree = nodes(spark, sf)
    return hierarchy.roll_up(hierarchy.closure(hierarchy.edges(tree), tree), genomes(spark, sf)).select("tax_id", "size_bp")


@query("ag_3_genome_presence", "taxonomy genomes", "select tax_id, has_direct, has_below from sizes", _SIZES)
def _(spark, sf):
    tree = nodes(spark, sf)
    sizes = hierarchy.roll_up(hierarchy.closure(hierarchy.edges(tree), tree), genomes(spark, sf))
    return sizes.select("tax_id", "has_direct", "has_below")


# Packing -------------------------------------------------------------------------------------------


def ffd_sql(items: str, capacity: str) -> str:
    """Common tables ``st(k, rn, id, grp, bins)``: first fit per key over ``items(k, id, sz)``."""
    return f"""
it as (select k, id, sz, {capacity} as cap, row_number() over (partition by k order by sz desc, id) rn from ({items}) x where sz <= {capacity}),
st(k, rn, id, grp, bins) as (
  select distinct k, cast(0 as bigint), cast(null as varchar), cast(null as bigint), cast([] as bigint[]) from it
  union all
  select it.k, it.rn, cast(it.id as varchar), g.p,
         case when g.p > len(st.bins) then list_append(st.bins, it.sz)
              else list_transform(st.bins, lambda b, i: case when i = g.p then b + it.sz else b end) end
  from st join it on it.rn = st.rn + 1 and it.k = st.k,
       lateral (select coalesce(list_position(list_transform(st.bins, lambda b: b + it.sz <= it.cap), true), len(st.bins) + 1) p) g)"""


SPECIES_CAPACITY = 400_000_000
GENUS_CAPACITY = 2_500_000_000
ACCESSION_CAPACITY = 40_000_000


def sized(spark, sf, rank):
    tree, pairs = pairs_at(spark, sf, rank)
    return hierarchy.roll_up(pairs, genomes(spark, sf)).join(tree.select("tax_id", "name"), "tax_id")


_SPECIES_ITEMS = "select 0 as k, s.tax_id as id, s.size_bp as sz from sizes s join taxonomy t on t.tax_id = s.tax_id where t.rnk = 'SPECIES'"


@query(
    "wn_8_pack_taxa", "taxonomy genomes",
    f"select cast(id as bigint) as tax_id, grp as bin from st where rn > 0 union all select id, null from ({_SPECIES_ITEMS}) where sz > {SPECIES_CAPACITY}",
    _SIZES + ", " + ffd_sql(_SPECIES_ITEMS, str(SPECIES_CAPACITY)),
)
def _(spark, sf):
    return packing.pack(sized(spark, sf, "SPECIES"), SPECIES_CAPACITY).select("tax_id", "bin")


_GENUS_MEMBERS = (
    "select ancestor as k, accession as id, sequence_length as sz from c join genomes g on g.tax_id = c.descendant"
    " join taxonomy t on t.tax_id = ancestor where t.rnk = 'GENUS'"
)


@query(
    "wn_9_pack_accessions", "taxonomy genomes",
    f"select k as taxon_id, id as accession, grp as bin from st where rn > 0 union all"
    f" select m.k, m.id, coalesce((select max(grp) from st where st.k = m.k), 0) + row_number() over (partition by m.k order by m.id) from ({_GENUS_MEMBERS}) m where sz > {ACCESSION_CAPACITY}",
    _SIZES + ", " + ffd_sql(_GENUS_MEMBERS, str(ACCESSION_CAPACITY)),
)
def _(spark, sf):
    _tree, pairs = pairs_at(spark, sf, "GENUS")
    members = hierarchy.genomes_below(pairs, genomes(spark, sf)).select("taxon_id", "accession", "sequence_length")
    binned = packing.pack_all(members, ACCESSION_CAPACITY, "sequence_length", "accession", ["taxon_id"])
    return binned.select("taxon_id", "accession", "bin")


@query(
    "wn_9_pack_null_sizes", "taxonomy genomes",
    f"select k as taxon_id, id as accession, grp as bin from st where rn > 0 union all"
    f" select m.k, m.id, coalesce((select max(grp) from st where st.k = m.k), 0) + row_number() over (partition by m.k order by m.id) from ({_GENUS_MEMBERS} and sequence_length % 10 <> 0) m where sz > {ACCESSION_CAPACITY}"
    f" union all select k, id, null from ({_GENUS_MEMBERS} and sequence_length % 10 = 0)",
    _SIZES + ", " + ffd_sql(_GENUS_MEMBERS + " and sequence_length % 10 <> 0", str(ACCESSION_CAPACITY)),
)
def _(spark, sf):
    """Hot keys through waves of small chunks; items without a size stay, without a bin."""
    _tree, pairs = pairs_at(spark, sf, "GENUS")
    members = hierarchy.genomes_below(pairs, genomes(spark, sf)).select("taxon_id", "accession", "sequence_length")
    members = members.withColumn("sequence_length", F.when(F.col("sequence_length") % 10 != 0, F.col("sequence_length")))
    chunk = max(10, members.count() // 60)
    binned = packing.pack_all(members, ACCESSION_CAPACITY, "sequence_length", "accession", ["taxon_id"], chunk, max_sizes=1)
    return binned.select("taxon_id", "accession", "bin")


_CLASSED_MEMBERS = f"select k, id, sz // 1000000 * 1000000 + 1000000 as sz from ({_GENUS_MEMBERS})"


@query(
    "wn_9_pack_by_runs", "taxonomy genomes",
    f"select k as taxon_id, id as accession, grp as bin from st where rn > 0 union all"
    f" select m.k, m.id, coalesce((select max(grp) from st where st.k = m.k), 0) + row_number() over (partition by m.k order by m.id) from ({_CLASSED_MEMBERS}) m where sz > {ACCESSION_CAPACITY}",
    _SIZES + ", " + ffd_sql(_CLASSED_MEMBERS, str(ACCESSION_CAPACITY)),
)
def _(spark, sf):
    """Lengths rounded up to whole megabases, so that all but small keys are planned from the runs of equal sizes."""
    _tree, pairs = pairs_at(spark, sf, "GENUS")
    members = hierarchy.genomes_below(pairs, genomes(spark, sf)).select("taxon_id", "accession", "sequence_length")
    members = members.withColumn("sequence_length", F.expr("sequence_length div 1000000 * 1000000 + 1000000"))
    binned = packing.pack_all(members, ACCESSION_CAPACITY, "sequence_length", "accession", ["taxon_id"], chunk_rows=10)
    return binned.select("taxon_id", "accession", "bin")


def genus_ffd(uses_more: str = "") -> str:
    items = "select 0 as k, s.tax_id as id, s.size_bp as sz from sizes s join taxonomy t on t.tax_id = s.tax_id where t.rnk = 'GENUS'"
    packed = (
        f", packed as (select s.tax_id, t.name, s.size_bp, s.n_genomes, st.grp as bin from sizes s join taxonomy t on t.tax_id = s.tax_id"
        " left join st on st.rn > 0 and cast(st.id as bigint) = s.tax_id where t.rnk = 'GENUS')"
    )
    return _SIZES + ", " + ffd_sql(items, "(select avg_cap from cap)") + packed


# The capacity is the rounded mean genus size, so that at every scale some genera exceed it.
CAPACITY_CTE = (
    "cap as (select cast(floor(sum(sequence_length) / 25) as bigint) as avg_cap from genomes), "
)


def genus_capacity(spark, sf) -> int:
    return genomes(spark, sf).agg(F.floor(F.sum("sequence_length") / 25).cast("bigint")).first()[0]


def packed_genera(spark, sf):
    return packing.pack(sized(spark, sf, "GENUS"), genus_capacity(spark, sf))


_TOTALS = (
    "select 'group' as level, bin as group_id, count(*) as n_species, cast(sum(n_genomes) as bigint) as n_genomes, cast(sum(size_bp) as bigint) as size_bp from packed where bin is not null group by bin"
    " union all select case when bin is null then 'exceeded' else 'grouped' end, null, count(*), cast(sum(n_genomes) as bigint), cast(sum(size_bp) as bigint) from packed group by 1"
    " union all select 'overall', null, count(*), cast(sum(n_genomes) as bigint), cast(sum(size_bp) as bigint) from packed"
)


@query("ag_4_group_totals", "taxonomy genomes", f"select * from ({_TOTALS}) where level = 'group'", CAPACITY_CTE + genus_ffd())
def _(spark, sf):
    return reports.split_totals(packed_genera(spark, sf)).filter("level = 'group'")


@query("ag_5_split_totals", "taxonomy genomes", _TOTALS, CAPACITY_CTE + genus_ffd())
def _(spark, sf):
    return reports.split_totals(packed_genera(spark, sf))


# Resume --------------------------------------------------------------------------------------------


@query("jn_4_remaining", "requested completed", "select item, line_number from requested where item not in (select item from completed)")
def _(spark, sf):
    return resume.remaining(derived(spark, sf, "requested"), derived(spark, sf, "completed"), "item")


_INCLUDE = ["genome", "protein", "gff3"]
_EXT = "case include_type when 'genome' then '.fna' when 'protein' then '.faa' when 'gff3' then '.gff' when 'cds' then '.cds' else '.gtf' end"


def disk_files(spark, sf):
    """Files on disk: from the line items, one per order and include type."""
    saved = derived(spark, sf, "saved_files")
    name = F.concat("accession", F.expr(_EXT))
    return saved.select(name.alias("name"), F.concat(F.lit("/out/"), name).alias("path"), name.alias("rel_path"), "accession", "include_type")


def trusted(spark, sf):
    """Manifest rows of those files; an empty hash, by the last digit of the order, is not trusted."""
    saved = derived(spark, sf, "saved_files")
    digest = F.when(F.substr("accession", F.lit(13), F.lit(1)) == "7", "").otherwise(F.col("accession"))
    return saved.select(F.concat("accession", F.expr(_EXT)).alias("filename"), digest.alias("expected_md5"))


def order_accessions(spark, sf):
    return given(spark, sf, "orders").select(
        F.concat(F.lit("GCA_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".1")).alias("accession"), "o_orderkey", "o_orderstatus"
    )


_COMPLETE = (
    "acc as (select 'GCA_' || lpad(cast(o_orderkey as varchar), 9, '0') || '.1' as accession, o_orderkey, o_orderstatus from orders),"
    f" good as (select distinct accession || {_EXT} as filename from saved_files where substr(accession, 13, 1) <> '7'),"
    " done as (select a.accession, count(*) as n_expected, count(g.filename) as n_found, count(*) = count(g.filename) as complete"
    "   from acc a, (values ('.fna'), ('.faa'), ('.gff')) e(x) left join good g on g.filename = a.accession || e.x group by 1)"
)
_COMPLETE = _COMPLETE.replace(
    "from acc a, (values ('.fna'), ('.faa'), ('.gff')) e(x) left join",
    "from (select accession, x from acc, (values ('.fna'), ('.faa'), ('.gff')) e(x)) a left join",
).replace("a.accession || e.x", "a.accession || a.x")


@query("jn_5_completeness", "saved_files", "select * from done", _COMPLETE)
def _(spark, sf):
    return resume.completeness(order_accessions(spark, sf).select("accession"), disk_files(spark, sf), trusted(spark, sf), _INCLUDE)


@query(
    "jn_6_taxa_with_files", "",
    "select distinct p_name || ' #' || p_size as taxon from part where p_size % 3 <> 0 and p_size % 4 <> 1",
)
def _(spark, sf):
    part = given(spark, sf, "part")
    taxa = part.select(F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string")).alias("taxon")).distinct()
    folder = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string"))
    name = F.expr("case when p_size % 4 = 1 then 'notes.txt' else 'GCA_000000001.1.fna' end")
    files = part.filter("p_size % 3 <> 0").select(name.alias("name"), F.concat(folder, F.lit("/"), name).alias("rel_path"))
    return resume.taxa_with_files(taxa, files, ["genome"])


@query(
    "jn_7_resume_taxa", "",
    "select p_name || ' #' || p_size as taxon, count(*) as n from part where p_partkey % 3 = 0 or p_size % 3 = 0 or p_size % 4 = 1 group by 1",
)
def _(spark, sf):
    part = given(spark, sf, "part")
    taxon = F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"))
    requested = part.select(taxon.alias("taxon"), "p_partkey", "p_size")
    folder = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string"))
    name = F.expr("case when p_size % 4 = 1 then 'notes.txt' else 'GCA_000000001.1.fna' end")
    files = part.filter("p_size % 3 <> 0").select(name.alias("name"), F.concat(folder, F.lit("/"), name).alias("rel_path"))
    # Items are unique per part here, so that a taxon listed twice is not completed by its twin.
    keyed = requested.withColumn("taxon", F.concat("taxon", F.when(F.col("p_partkey") % 3 == 0, "?").otherwise("")))
    completed = keyed.filter("p_partkey % 3 <> 0").select("taxon").distinct()
    left = resume.resume_taxa(keyed, completed, files, ["genome"])
    return left.groupBy(F.replace("taxon", F.lit("?"), F.lit("")).alias("taxon")).agg(F.count("*").alias("n"))


_REMAINING = "select accession from acc where not (o_orderstatus = 'F' and accession in (select accession from done where complete))"


@query("jn_7_resume", "saved_files", _REMAINING, _COMPLETE)
def _(spark, sf):
    requested = order_accessions(spark, sf)
    completed = requested.filter("o_orderstatus = 'F'").select("accession")
    left = resume.resume_accessions(requested, completed, disk_files(spark, sf), trusted(spark, sf), _INCLUDE)
    return left.select("accession")


@query("jn_7_resume_without_state", "saved_files", "select accession from acc where accession not in (select accession from done where complete)", _COMPLETE)
def _(spark, sf):
    requested = order_accessions(spark, sf).select("accession")
    left = resume.resume_accessions(requested, requested.limit(0), disk_files(spark, sf), trusted(spark, sf), _INCLUDE)
    return left


@query("pl_4_plan_resume", "saved_files", f"select accession, row_number() over (order by accession) as position, cast(floor((row_number() over (order by accession) - 1) / 100) as bigint) + 1 as batch from ({_REMAINING})", _COMPLETE)
def _(spark, sf):
    from cladeledger.plans.audit import plan_resume

    requested = order_accessions(spark, sf).withColumn("line", F.col("o_orderkey"))
    completed = requested.filter("o_orderstatus = 'F'").select("accession")
    plan = plan_resume(requested, completed, disk_files(spark, sf), trusted(spark, sf), _INCLUDE)
    return plan.select("accession", "position", "batch")


@query("se_6_invalid_completed", "saved_files", "select accession from acc where o_orderstatus = 'F' and accession not in (select accession from done where complete)", _COMPLETE)
def _(spark, sf):
    completed = order_accessions(spark, sf).filter("o_orderstatus = 'F'").select("accession")
    valid = resume.completeness(completed, disk_files(spark, sf), trusted(spark, sf), _INCLUDE).filter("complete")
    return resume.remaining(completed, valid, "accession")


@query("wn_1_first_occurrence", "requested", "select item, min(line_number) as line_number, count(*) as copies from requested group by 1")
def _(spark, sf):
    return dedup.first_wins(derived(spark, sf, "requested"), ["item"], F.col("line_number"), "copies")


@query("wn_2_last_occurrence", "files", "select name, arg_max(expected_hash, doc_id) as expected_hash from (select *, source || '/' || (doc_id % 7) as name from files) group by 1")
def _(spark, sf):
    rows = derived(spark, sf, "files").select(
        F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("name"), "expected_hash", "doc_id"
    )
    return dedup.last_wins(rows, ["name"], F.col("doc_id")).select("name", "expected_hash")


@query("wn_3_first_by_name", "files", "select name, min(path) as path, count(*) as copies from (select 'n' || (doc_id % 50) as name, file_path as path from files) group by 1")
def _(spark, sf):
    files = derived(spark, sf, "files").select(F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.col("file_path").alias("path"))
    return resume.index_by_name(files)


@query("wn_5_batches", "requested", "select item, line_number, row_number() over (order by item, line_number, rn) as position, cast(floor((row_number() over (order by item, line_number, rn) - 1) / 100) as bigint) + 1 as batch from (select *, 0 as rn from requested)")
def _(spark, sf):
    return resume.in_batches(derived(spark, sf, "requested"), [F.col("item"), F.col("line_number")])


@query("wn_6_numbered_lists", "tasks", "select status, event_id, row_number() over (partition by status order by original_path, event_id) as number from tasks")
def _(spark, sf):
    tasks = derived(spark, sf, "tasks").select("status", "event_id", "original_path")
    return with_row_number(tasks, ["status"], [F.col("original_path"), F.col("event_id")], "number").drop("original_path")


@query("wn_6_numbered_lists_ranged", "tasks", "select status, event_id, row_number() over (partition by status order by original_path, event_id) as number from tasks")
def _(spark, sf):
    tasks = derived(spark, sf, "tasks").select("status", "event_id", "original_path")
    numbered = with_row_number(tasks, ["status"], [F.col("original_path"), F.col("event_id")], "number", max_group_rows=10)
    return numbered.drop("original_path")


@query("wn_7_latest_state", "task_events", "select task, arg_max(status, seq) as status, max(seq) as seq from task_events group by 1")
def _(spark, sf):
    return resume.latest_state(derived(spark, sf, "task_events").drop("ts"), "task", F.col("seq"))


_PROGRESS_CASE = (
    "case when event_type in ('view', 'click') and event_id % 9 = user_id % 9 then 'completed'"
    " when event_type = 'error' then 'failed' else 'other' end"
)
_PROGRESS = f"p as (select user_id as item, event_id as seq, {_PROGRESS_CASE} as state from events)"
_PROGRESS_STATE = (
    "select item, 'completed' as state from p where state = 'completed' group by 1"
    " union all select item, 'failed' from p where state in ('completed', 'failed') group by 1 having arg_max(state, seq) = 'failed'"
)


def progress_events(spark, sf):
    columns = [F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.expr(_PROGRESS_CASE).alias("state")]
    return given(spark, sf, "events").select(*columns)


@query("snk_8_progress_state", "", _PROGRESS_STATE, _PROGRESS)
def _(spark, sf):
    return resume.progress_state(progress_events(spark, sf), F.col("seq"))


@query("ag_18_progress_summary", "", f"select count(case when state = 'completed' then 1 end) as completed_count, count(case when state = 'failed' then 1 end) as failed_count, 90.5::double as elapsed_seconds from ({_PROGRESS_STATE})", _PROGRESS)
def _(spark, sf):
    states = resume.progress_state(progress_events(spark, sf), F.col("seq"))
    return resume.progress_summary(states, F.lit(10.0), F.lit(100.5))


_WANTED = "['genome', 'protein', 'gff3']"


@query(
    "ag_13_accession_outcome", "saved_files",
    f"select accession, array_to_string(list_sort(list_distinct(list(include_type))), ',') as saved_types, array_to_string(list_sort(list_filter({_WANTED}, lambda t: not list_contains(list(include_type), t))), ',') as missing_types,"
    f" len(list_filter({_WANTED}, lambda t: not list_contains(list(include_type), t))) = 0 as complete from saved_files group by 1",
)
def _(spark, sf):
    return resume.accession_outcome(derived(spark, sf, "saved_files"), _INCLUDE)


@query("se_2_missing_types", "saved_files", f"select accession, t as missing_type from (select distinct accession from saved_files) a, (select unnest({_WANTED}) as t) w where not exists (select 1 from saved_files s where s.accession = a.accession and s.include_type = t)")
def _(spark, sf):
    outcome = resume.accession_outcome(derived(spark, sf, "saved_files"), _INCLUDE).filter("NOT complete")
    return outcome.select("accession", F.explode(F.split("missing_types", ",")).alias("missing_type"))


@query("se_3_complete_accessions", "saved_files", "select accession from saved_files where include_type in ('genome', 'protein', 'gff3') group by 1 having count(distinct include_type) = 3")
def _(spark, sf):
    return resume.accession_outcome(derived(spark, sf, "saved_files"), _INCLUDE).filter("complete").select("accession")


# Integrity -----------------------------------------------------------------------------------------


def inventory(spark, sf):
    files = derived(spark, sf, "files").filter("computed_hash IS NOT NULL")
    return files.select(F.concat(F.lit("/data/"), "file_path").alias("path"), F.lit(1).cast("bigint").alias("size"), "computed_hash")


def entries(spark, sf):
    return derived(spark, sf, "files").select("expected_hash", "file_path", F.concat(F.lit("/data/"), "file_path").alias("abs_path"))


@query("jn_8_match_inventory", "files", "select file_path, computed_hash is not null as present from files")
def _(spark, sf):
    matched = integrity.match_inventory(entries(spark, sf), inventory(spark, sf))
    return matched.select("file_path", F.col("exists").alias("present"))


def verification(spark, sf):
    hashes = inventory(spark, sf).select("path", "computed_hash", F.lit(None).cast("string").alias("error"))
    return integrity.verify(integrity.match_inventory(entries(spark, sf), inventory(spark, sf)), hashes)


_STATE = "case when computed_hash is null then 'missing' when computed_hash = expected_hash then 'pass' else 'fail' end"


@query(
    "ag_6_verification_totals", "files",
    "select count(*) as total_files, count(case when s = 'pass' then 1 end) as passed, count(case when s = 'fail' then 1 end) as failed, count(case when s = 'missing' then 1 end) as missing, cast(0 as bigint) as errors, count(case when s <> 'pass' then 1 end) = 0 as success,"
    f" case when count(case when s <> 'pass' then 1 end) = 0 then 0::bigint else 1::bigint end as exit_code, true as counts_valid, count(case when s = 'pass' then 1 end) / count(*)::double * 100 as success_rate from (select {_STATE} as s from files)",
)
def _(spark, sf):
    return integrity.count_states(verification(spark, sf))


@query("se_7_failing_files", "files", f"select file_path, {_STATE} as status from files where {_STATE} <> 'pass'")
def _(spark, sf):
    return integrity.failing(verification(spark, sf)).select("file_path", "status")


@query(
    "jn_10_hash_by_accession", "paths",
    "select doc_id, acc as accession, name, case when doc_id % 3 > 0 then md5(path) end as expected_hash from (select doc_id, acc, path, regexp_extract(path, '[^/]*$') as name from paths) p",
)
def _(spark, sf):
    paths = derived(spark, sf, "paths")
    listed = paths.filter("doc_id % 3 > 0").select(F.col("path").alias("file_path"), F.md5("path").alias("expected_hash"))
    files = paths.select("doc_id", F.col("acc").alias("accession"), text.basename(F.col("path")).alias("name"))
    return integrity.hash_by_accession(listed, files)


_WRITTEN = (
    "case doc_id % 4 when 0 then file_path when 1 then replace(file_path, '/', '//') when 2 then replace(file_path, '/', chr(92))"
    " else concat('elsewhere/root', cast(doc_id as varchar(20)), '.fna') end"
)
_EXPECTED = "case when doc_id % 4 = 3 and doc_id % 8 = 7 then null else expected_hash end"


def stored_entries(spark, sf):
    files = derived(spark, sf, "files")
    nested = files.filter("doc_id % 4 <> 3").select("file_path", "expected_hash")
    root = files.filter("doc_id % 8 = 3").select(F.expr("concat('root', doc_id, '.fna')").alias("file_path"), "expected_hash")
    return nested.unionByName(root)


@query("jn_13_expected_hash", "files", f"select doc_id, {_WRITTEN} as path, {_EXPECTED} as expected_hash from files")
def _(spark, sf):
    paths = derived(spark, sf, "files").select("doc_id", F.expr(_WRITTEN).alias("path"))
    return integrity.expected_hash_of(paths, stored_entries(spark, sf))


@query("jn_18_reverify", "files", f"select doc_id, coalesce(computed_hash = {_EXPECTED}, false) as passed from files")
def _(spark, sf):
    files = derived(spark, sf, "files")
    placed = files.select("doc_id", F.expr(_WRITTEN).alias("path"))
    hashes = files.filter("computed_hash IS NOT NULL").select(F.expr(_WRITTEN).alias("path"), "computed_hash")
    return integrity.reverify(placed, stored_entries(spark, sf), hashes).select("doc_id", "passed")


# Manifest ------------------------------------------------------------------------------------------

_MERGE = (
    "select filename, m.expected_md5 as old_md5, b.expected_md5 as new_md5, case when b.filename is null then 'keep' when m.filename is null then 'insert'"
    " when m.expected_md5 = b.expected_md5 then 'unchanged' else 'conflict' end as action from manifest m full join batch b using (filename)"
)


@query("jn_15_manifest_merge", "manifest batch", _MERGE)
def _(spark, sf):
    return manifest.classify_merge(derived(spark, sf, "manifest"), derived(spark, sf, "batch"))


@query("jn_15_merged_manifest", "manifest batch", f"select filename, case when action = 'insert' then new_md5 else old_md5 end as expected_md5 from ({_MERGE})")
def _(spark, sf):
    return manifest.merge(derived(spark, sf, "manifest"), derived(spark, sf, "batch"))


def output_files(spark, sf):
    names = derived(spark, sf, "paths").filter("doc_id % 6 <> 1").select(filetypes.standard_name(F.col("path"), F.col("acc")).alias("name"))
    return names.withColumns({"rel_path": F.col("name"), "path": F.concat(F.lit("/out/"), "name")})


_REBUILD = (
    "reb as (select path as file_path, acc, x, case when a is null then 'unrecognized' when not exists (select 1 from paths q where q.doc_id % 4 <> 2 and q.acc = a) then 'unrequested'"
    " when t is null then 'unrecognized' when not exists (select 1 from outs o where o.name = a || x) then 'missing_output' else 'commit' end as reason, a || x as filename"
    " from (select *, nullif(regexp_extract(path, '(GC[AF]_[0-9]+\\.[0-9]+)', 1), '') as a from typed))"
)
_TYPED = (
    "typed as (select doc_id, path, acc, case when doc_id % 13 in (1, 0, 3, 4, 9, 10) then 'yes' end as t,"
    " case doc_id % 13 when 0 then '.faa' when 1 then '.cds' when 2 then '.rna.fna' when 3 then '.gff' when 4 then '.gff' when 5 then '.gtf' when 6 then '.gbff' when 7 then '.jsonl' when 8 then '.jsonl' when 9 then '.fna' when 10 then '.fna' when 11 then '.gz' else '' end as x from paths),"
    " outs as (select acc || x as name from typed where doc_id % 6 <> 1)"
)
_REBUILD_INCLUDE = ["genome", "protein", "cds", "gff3"]


def rebuilt(spark, sf):
    paths = derived(spark, sf, "paths")
    listed = paths.select(F.col("path").alias("file_path"), F.md5("path").alias("expected_hash"))
    requested = paths.filter("doc_id % 4 <> 2").select(F.col("acc").alias("accession"))
    return manifest.rebuild_candidates(listed, requested, output_files(spark, sf), _REBUILD_INCLUDE)


@query("jn_14_rebuild_candidates", "paths", "select file_path, reason from reb", f"{_TYPED}, {_REBUILD}")
def _(spark, sf):
    return rebuilt(spark, sf).select("file_path", "reason")


@query("ag_20_rebuild_counts", "paths", "select reason, count(*) as n_entries, count(distinct filename) as n_names from reb group by 1", f"{_TYPED}, {_REBUILD}")
def _(spark, sf):
    return manifest.rebuild_counts(rebuilt(spark, sf))


def rebuilt_manifest(spark, sf):
    from cladeledger.plans.audit import rebuild_manifest

    paths = derived(spark, sf, "paths")
    listed = paths.select(F.col("path").alias("file_path"), F.md5("path").alias("expected_hash"))
    requested = paths.filter("doc_id % 4 <> 2").select(F.col("acc").alias("accession"))
    current = listed.select(F.col("file_path").alias("filename"), F.col("expected_hash").alias("expected_md5")).limit(0)
    return rebuild_manifest(listed, requested, output_files(spark, sf), current, _REBUILD_INCLUDE)


@query("pl_5_rebuild_manifest", "paths", "select filename, md5(min(file_path)) as new_md5, 'insert' as action from reb where reason = 'commit' group by 1", f"{_TYPED}, {_REBUILD}")
def _(spark, sf):
    actions, _counts = rebuilt_manifest(spark, sf)
    return actions.select("filename", "new_md5", "action")


@query("pl_5_rebuild_reasons", "paths", "select reason, count(*) as n_entries, count(distinct filename) as n_names from reb group by 1", f"{_TYPED}, {_REBUILD}")
def _(spark, sf):
    _actions, counts = rebuilt_manifest(spark, sf)
    return counts


@query(
    "jn_16_legacy_import", "paths",
    "select filename, accession, include_type from (select distinct name as filename, regexp_extract(name, '(GC[AF]_[0-9]+\\.[0-9]+)', 1) as accession,"
    " case when name like '%.faa' then 'protein' when name like '%.cds' then 'cds' when name like '%.rna.fna' then 'rna' when name like '%.gff' then 'gff3' when name like '%.gtf' then 'gtf' when name like '%.gbff' then 'gbff' when name like '%.jsonl' then 'seq-report' else 'genome' end as include_type from outs)"
    " where exists (select 1 from typed where doc_id % 5 <> 2 and acc || x = filename)",
    _TYPED,
)
def _(spark, sf):
    names = derived(spark, sf, "paths").filter("doc_id % 5 <> 2").select(
        filetypes.standard_name(F.col("path"), F.col("acc")).alias("file_path"), F.lit("0" * 32).alias("expected_hash")
    )
    empty = names.limit(0)
    imported = manifest.legacy_import(empty, names.distinct(), output_files(spark, sf))
    return imported.select("filename", "accession", "include_type")


@query("ag_14_manifest_coverage", "files", "select count(case when doc_id % 3 <> 0 then 1 end) as tracked_artifacts, count(*) as discovered_artifacts, count(case when doc_id % 3 = 0 then 1 end) as untracked_artifacts from files where doc_id % 4 <> 1")
def _(spark, sf):
    files = derived(spark, sf, "files")
    name = F.translate("file_path", "/", "_")
    outputs = files.withColumn("name", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit(".hidden"), name)).otherwise(name))
    known = files.filter("doc_id % 3 <> 0").select(name.alias("filename"), F.col("expected_hash").alias("expected_md5"))
    return manifest.coverage(outputs.select("name", F.col("name").alias("rel_path")), known)


# Repair --------------------------------------------------------------------------------------------


@query(
    "ag_19_accession_totals", "files",
    f"select count(*) as n_files, count(distinct case when doc_id % 2 = 0 then substr(file_path, strpos(file_path, '/') + 1, 15) end) as n_accessions, count(case when doc_id % 2 = 1 then 1 end) as n_skipped from files where {_STATE} <> 'pass'",
)
def _(spark, sf):
    bad = integrity.failing(verification(spark, sf))
    odd = F.regexp_extract("file_path", "GCA_0*([0-9]+)[.]", 1).cast("int") % 2 == 1
    renamed = bad.withColumn("file_path", F.when(odd, F.regexp_replace("file_path", "GCA_", "x_")).otherwise(F.col("file_path")))
    return repair.accession_totals(repair.failed_files(renamed))


def tasks(spark, sf):
    rows = derived(spark, sf, "tasks")
    nothing = F.lit(None).cast("string")
    return rows.select(
        "task_id", "status", "accession_id", "md5_file_path", "md5sum_dir", "original_path",
        F.col("original_path").alias("target_path"), "expected_hash", F.lit("fail").alias("initial_status"),
        nothing.alias("cached_file"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("backups/"), "original_path")).alias("backup_path"),
        "attempts", nothing.alias("last_error"), nothing.alias("computed_hash"),
        F.concat(F.lit("2024-01-0"), (F.col("event_id") % 9 + 1).cast("string")).alias("created_at"),
        F.concat(F.lit("2024-02-0"), (F.col("event_id") % 8 + 1).cast("string")).alias("updated_at"),
    )


# All fields of the tasks above.
TASK_FIELDS_SQL = (
    "task_id, status, accession_id, md5_file_path, md5sum_dir, original_path, original_path as target_path, expected_hash, 'fail' as initial_status,"
    " null::varchar as cached_file, case when event_id % 3 = 0 then 'backups/' || original_path end as backup_path, attempts, null::varchar as last_error,"
    " null::varchar as computed_hash, '2024-01-0' || (event_id % 9 + 1) as created_at, '2024-02-0' || (event_id % 8 + 1) as updated_at"
)


def task_hashes(spark, sf):
    """Current hashes of task files; those of event ids not divisible by three still match."""
    rows = derived(spark, sf, "tasks")
    return rows.select(
        F.col("original_path").alias("path"),
        F.when(F.col("event_id") % 3 == 0, F.md5(F.lit("changed"))).otherwise(F.col("expected_hash")).alias("computed_hash"),
    )


@query(
    "jn_17_task_merge", "tasks",
    "select * exclude (event_id) replace (case when event_id % 2 = 0 then status else 'PENDING' end as status,"
    " case when event_id % 2 = 1 or event_id % 4 = 0 and accession_id is null then 'GCA_000000000.9' else accession_id end as accession_id,"
    " case when event_id % 2 = 1 or event_id % 4 = 0 and accession_id is null then 'now' else updated_at end as updated_at,"
    f" case when event_id % 2 = 0 then backup_path end as backup_path) from (select event_id, {TASK_FIELDS_SQL} from tasks)",
)
def _(spark, sf):
    """Saved tasks come back with all their fields; fresh ones lack a backup."""
    all_tasks = tasks(spark, sf).join(derived(spark, sf, "tasks").select("task_id", "event_id"), "task_id")
    saved = all_tasks.filter("event_id % 2 = 0").drop("event_id")
    fresh = all_tasks.filter("event_id % 4 = 0 OR event_id % 2 = 1").drop("event_id", "backup_path")
    fresh = fresh.withColumns({"status": F.lit("PENDING"), "accession_id": F.lit("GCA_000000000.9"), "updated_at": F.lit("now")})
    return repair.merge_tasks(saved, fresh)


_RECOVERED = (
    "case when accession_id is null then case when status in ('FIXED', 'SKIPPED_NO_ACCESSION') then status else 'SKIPPED_NO_ACCESSION' end"
    " when status = 'FIXED' and event_id % 3 = 0 then 'DOWNLOAD_QUEUED'"
    " when status in ('PENDING', 'DOWNLOADING', 'FAILED_RETRYABLE') then 'DOWNLOAD_QUEUED' when status = 'ORGANIZING' then 'DOWNLOADED'"
    " when status = 'VERIFYING' then 'ORGANIZED' else status end"
)


@query(
    "st_2_recovered_tasks", "tasks",
    f"select task_id, {_RECOVERED} as status, case when accession_id is null and {_RECOVERED} <> status then '{fixed.SKIPPED_TEXT}' when accession_id is not null and status = 'FIXED' and {_RECOVERED} <> status then '{fixed.STALE_FIX_TEXT}' end as last_error from tasks",
)
def _(spark, sf):
    return repair.recover(tasks(spark, sf), task_hashes(spark, sf)).select("task_id", "status", "last_error")


@query(
    "st_2_requeued_tasks", "tasks",
    "select task_id, case when status in ('STILL_FAILED', 'FAILED_RETRYABLE') then 'DOWNLOAD_QUEUED' else status end as status, case when status in ('STILL_FAILED', 'FAILED_RETRYABLE') then attempts + 1 else attempts end as attempts from tasks",
)
def _(spark, sf):
    return repair.requeue_failed(tasks(spark, sf)).select("task_id", "status", "attempts")


def cache(spark, sf):
    """Cached downloads, two versions of some files."""
    rows = derived(spark, sf, "tasks").filter("accession_id IS NOT NULL AND event_id % 4 <> 1")
    copies = rows.select("md5_file_path", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("copy"))
    rna = F.regexp_replace("md5_file_path", "[.]fna$", ".rna.fna")
    cached = copies.select(F.col("md5_file_path").alias("name"), F.concat(F.lit("/cache/"), "copy", F.lit("/"), "md5_file_path").alias("path"))
    return cached.unionByName(copies.select(rna.alias("name"), F.concat(F.lit("/cache/0/"), rna).alias("path")))


@query(
    "jn_12_cache_match", "tasks",
    "select task_id, case when status = 'DOWNLOAD_QUEUED' and accession_id is not null and event_id % 4 <> 1 then '/cache/a/' || md5_file_path end as cached_file,"
    " case when status = 'DOWNLOAD_QUEUED' then case when accession_id is not null and event_id % 4 <> 1 then 'DOWNLOADED' else 'DOWNLOADING' end else status end as status from tasks",
)
def _(spark, sf):
    return repair.match_cache(tasks(spark, sf), cache(spark, sf)).select("task_id", "cached_file", "status")


def as_returned(df):
    """Rows with their place ``no`` in the order in which a table returns them when it is written."""
    path = new_path(df.sparkSession, "ordered")
    df.write.parquet(path)
    rows = df.sparkSession.read.parquet(path).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    return with_row_number(rows, [], [F.col("_at")], "no").drop("_at")


@query("so_5_accessions_to_fetch", "tasks", "select row_number() over (order by accession_id nulls first) as no, accession_id from (select distinct accession_id from tasks where status = 'DOWNLOADING')")
def _(spark, sf):
    return as_returned(repair.accessions_to_fetch(tasks(spark, sf)))


@query(
    "jn_11_match_downloads", "tasks",
    "select t.accession_id, '/dl/' || replace(md5_file_path, '.fna', x) as path, case when x = '.fna' and event_id % 2 = 0 then original_path end as original_path from tasks t, (values ('.fna'), ('.faa')) v(x) where accession_id is not null",
)
def _(spark, sf):
    rows = derived(spark, sf, "tasks").filter("accession_id IS NOT NULL")
    kinds = rows.select("accession_id", F.explode(F.array(F.lit(".fna"), F.lit(".faa"))).alias("x"), "md5_file_path")
    name = F.concat(F.regexp_replace("md5_file_path", "[.]fna$", ""), "x")
    downloads = kinds.select("accession_id", name.alias("name"), F.concat(F.lit("/dl/"), name).alias("path"))
    failed = rows.filter("event_id % 2 = 0").select("accession_id", "md5_file_path", "original_path")
    return repair.match_downloads(downloads, failed)


@query(
    "ag_8_task_summary", "tasks",
    "select count(*) as total, count(case when status = 'FIXED' then 1 end) as fixed, count(case when status = 'STILL_FAILED' then 1 end) as still_failed, count(case when status = 'SKIPPED_NO_ACCESSION' then 1 end) as skipped, count(case when status = 'FAILED_RETRYABLE' then 1 end) as retryable_failed, count(case when status = 'FAILED_FATAL' then 1 end) as fatal_failed from tasks",
)
def _(spark, sf):
    return repair.summarize(tasks(spark, sf))


@query("ag_9_status_counts", "tasks", "select status, count(*) as n_tasks from tasks group by 1")
def _(spark, sf):
    return repair.status_counts(tasks(spark, sf))


@query("se_5_tasks_by_status", "tasks", "select task_id from tasks where status in ('ORGANIZED', 'VERIFYING')")
def _(spark, sf):
    return tasks(spark, sf).filter(F.col("status").isin("ORGANIZED", "VERIFYING")).select("task_id")


@query(
    "ag_17_repair_result", "tasks",
    "select count(*) as total_failed, count(case when accession_id is not null and status <> 'SKIPPED_NO_ACCESSION' then 1 end) as redownloaded, count(case when status = 'FIXED' then 1 end) as successfully_fixed,"
    " count(case when status in ('STILL_FAILED', 'FAILED_RETRYABLE', 'FAILED_FATAL') then 1 end) as still_failed, count(case when status = 'SKIPPED_NO_ACCESSION' then 1 end) as skipped,"
    " count(case when status = 'FIXED' then 1 end) / count(case when accession_id is not null and status <> 'SKIPPED_NO_ACCESSION' then 1 end)::double * 100 as success_rate from tasks",
)
def _(spark, sf):
    return repair.repair_result(tasks(spark, sf))


@query(
    "ag_17_repair_outcomes", "tasks",
    "select case status when 'FIXED' then 'fixed' when 'SKIPPED_NO_ACCESSION' then 'skipped' else 'still_failed' end as section, original_path as path, task_id from tasks where status in ('FIXED', 'SKIPPED_NO_ACCESSION', 'STILL_FAILED', 'FAILED_RETRYABLE', 'FAILED_FATAL')",
)
def _(spark, sf):
    return repair.outcomes(tasks(spark, sf))


# Layout --------------------------------------------------------------------------------------------


def layout_files(spark, sf):
    rows = derived(spark, sf, "paths").select("doc_id", F.col("path").alias("rel_path"), text.basename(F.col("path")).alias("name"))
    kind = filetypes.file_type(F.col("name"))
    return rows.withColumns({"path": F.concat(F.lit("/src/"), "rel_path"), "include_type": kind}).filter("include_type IS NOT NULL")


_LAYOUT = (
    "plan as (select doc_id, path as rel_path, regexp_extract(path, '[^/]*$') as base, case when a <> '' then a || x else regexp_extract(path, '[^/]*$') end as out_name"
    " from (select *, regexp_extract(path, '(GC[AF]_[0-9]+\\.[0-9]+)', 1) as a from typed) where doc_id % 13 not in (8, 11, 12))"
)


@query("jn_19_collisions", "paths", "select out_name, count(*) as n_sources from (select replace(out_name, '.faa', '.fna') as out_name, doc_id from plan union all select out_name, doc_id from plan where doc_id % 9 = 0) group by 1 having count(*) > 1", f"{_TYPED}, {_LAYOUT}")
def _(spark, sf):
    plan = layout.rename_plan(layout_files(spark, sf), ["doc_id"])
    twice = plan.withColumn("out_name", F.replace("out_name", F.lit(".faa"), F.lit(".fna"))).unionByName(plan.filter("doc_id % 9 = 0"))
    return layout.collisions(twice)


_RESOLVE = (
    "select p.doc_id, case when p.doc_id % 13 in (8, 11, 12) then u.o else plan.out_name end as out_name from paths p left join plan using (doc_id)"
    " left join (select base, min(out_name) as o from plan group by 1 having count(distinct out_name) = 1) u on u.base = regexp_extract(p.path, '[^/]*$')"
)


@query("jn_9_resolved_names", "paths", _RESOLVE, f"{_TYPED}, {_LAYOUT}")
def _(spark, sf):
    mapping = layout.checksum_mapping(layout.rename_plan(layout_files(spark, sf)))
    listed = derived(spark, sf, "paths").select("doc_id", F.col("path").alias("file_path"))
    return layout.resolve_names(listed, mapping).select("doc_id", "out_name")


@query(
    "jn_9_one_shared_name", "paths",
    "select doc_id, case when doc_id % 10 = 9 then null when doc_id % 10 = 8 then 'solo' || doc_id else 'out' || doc_id end as out_name from paths",
)
def _(spark, sf):
    """Nine tenths of the paths share one name; those that are known resolve by themselves, the last tenth by no key."""
    number = F.col("doc_id").cast("string")
    rows = derived(spark, sf, "paths").select("doc_id", F.when(F.col("doc_id") % 10 == 8, F.concat(F.lit("solo"), number, F.lit(".faa"))).otherwise("protein.faa").alias("name"))
    known = rows.filter("doc_id % 10 < 9")
    out = F.when(F.col("doc_id") % 10 == 8, F.concat(F.lit("solo"), number)).otherwise(F.concat(F.lit("out"), number))
    source = F.concat(F.lit("data/"), number, F.lit("/"), "name")
    mapping = layout.checksum_mapping(known.select(source.alias("rel_path"), out.alias("out_name")))
    folder = F.when(F.col("doc_id") % 10 == 8, F.lit("moved/")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("./data/"), number, F.lit("/"))).otherwise(F.concat(F.lit("data/"), number, F.lit("/")))
    return layout.resolve_names(rows.select("doc_id", F.concat(folder, "name").alias("file_path")), mapping).select("doc_id", "out_name")


@query("pl_6_layout", "paths", "select out_name, md5(arg_max(rel_path, doc_id)) as expected_hash from plan group by 1", f"{_TYPED}, {_LAYOUT}")
def _(spark, sf):
    plan = layout.rename_plan(layout_files(spark, sf))
    listed = derived(spark, sf, "paths").select(
        F.col("path").alias("file_path"), F.md5("path").alias("expected_hash"), F.col("doc_id").alias("line")
    )
    resolved = layout.resolve_names(listed, layout.checksum_mapping(plan))
    return layout.merged_checksums(resolved).select("out_name", "expected_hash")


@query("se_1_list_union", "files", "select name, arg_max(h, (list_no, doc_id)) as expected_hash from (select 'f' || (doc_id % 400) as name, expected_hash as h, 1 as list_no, doc_id from files union all select 'f' || (doc_id % 300), md5(expected_hash), 2, doc_id from files) group by 1")
def _(spark, sf):
    files = derived(spark, sf, "files")

    def part(number, modulus, digest):
        return files.select(
            F.concat(F.lit("f"), (F.col("doc_id") % modulus).cast("string")).alias("out_name"), digest.alias("expected_hash"),
            F.struct(F.lit(number).alias("list_no"), F.col("doc_id")).alias("line"),
        )

    both = part(1, 400, F.col("expected_hash")).unionByName(part(2, 300, F.md5("expected_hash")))
    return layout.merged_checksums(both).select(F.col("out_name").alias("name"), "expected_hash")


def folder_files(spark, sf):
    rows = derived(spark, sf, "paths").join(given(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    names = rows.select(F.col("source").alias("folder"), F.concat("doc_id", F.lit("_"), text.basename(F.col("path"))).alias("name"))
    lists = rows.select(F.col("source").alias("folder"), F.lit("md5sum.txt").alias("name")).distinct()
    return names.unionByName(lists.filter("folder <> 'src3'"))


def folder_entries(spark, sf):
    rows = derived(spark, sf, "checksum_lines").join(given(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    parsed = rows.withColumn("e", checksums.parse_checksum_line(F.col("line"), "lenient"))
    content = parsed.filter("trim(line) <> '' AND line NOT LIKE '#%'")
    return content.select(F.col("source").alias("folder"), "doc_id", F.col("e.hash").alias("expected_hash"), F.col("e.path").alias("file_path"))


_GOOD_LINE = "(doc_id % 9 in (0, 1, 2, 6, 8))"


_FOLDERS_SQL = (
    "select source as folder, count(case when doc_id % 13 not in (11, 12) then 1 end) as total_files, count(case when doc_id % 13 in (1, 2, 10) then 1 end) as fna_files, source <> 'src3' as md5_file_exists,"
    f" bool_or({_GOOD_LINE}) as md5_valid, bool_and(doc_id % 9 <> 8) as md5_uses_forward_slashes, true as directory_exists from documents group by source"
)


@query("ag_15_folder_validation", "paths", _FOLDERS_SQL)
def _(spark, sf):
    return layout.validate_folders(folder_files(spark, sf), folder_entries(spark, sf))


@query(
    "ag_15_absent_folders", "paths",
    f"select * from ({_FOLDERS_SQL}) where folder in (select source from documents where doc_id % 2 = 0) union all select distinct 'no' || source, 0, 0, false, false, false, false from documents where doc_id % 2 = 0",
)
def _(spark, sf):
    """Only the asked folders, half of which do not exist."""
    asked = given(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.explode(F.array("source", F.concat(F.lit("no"), "source"))).alias("folder"))
    return layout.validate_folders(folder_files(spark, sf), folder_entries(spark, sf), asked)


@query(
    "ag_15_file_names", "",
    "select folder, include_type, count(*) as n, count(distinct name) as n_names from (select source as folder, doc_id as name, case doc_id % 13 when 0 then 'protein' when 1 then 'cds' when 2 then 'rna' when 3 then 'gff3' when 4 then 'gff3' when 5 then 'gtf' when 6 then 'gbff' when 7 then 'seq-report' when 8 then 'seq-report' when 9 then 'genome' when 10 then 'genome' end as include_type from documents) where include_type is not null group by 1, 2",
)
def _(spark, sf):
    named = layout.file_names_by_type(folder_files(spark, sf))
    return named.groupBy("folder", "include_type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query(
    "ag_15_files_by_type", "",
    "select source as folder, t as include_type, count(*) as n_files from (select source, case doc_id % 13 when 0 then 'protein' when 1 then 'cds' when 2 then 'rna' when 3 then 'gff3' when 4 then 'gff3' when 5 then 'gtf' when 6 then 'gbff' when 7 then 'seq-report' when 8 then 'seq-report' when 9 then 'genome' when 10 then 'genome' end as t from documents) where t is not null group by 1, 2",
)
def _(spark, sf):
    return layout.files_by_type(folder_files(spark, sf))


@query(
    "ag_16_list_compatibility", "",
    f"select source || '/' || (doc_id % 9) as folder, bool_and({_GOOD_LINE}) as format_valid, bool_and({_GOOD_LINE} and doc_id % 9 <> 8) as paths_unix_style, bool_and({_GOOD_LINE} and doc_id % 9 <> 1) as files_referenced_exist,"
    f" bool_and({_GOOD_LINE} and doc_id % 9 not in (1, 8)) as compatible_with_md5sum from documents where doc_id % 9 not in (3, 4) group by 1",
)
def _(spark, sf):
    listed = folder_entries(spark, sf).withColumn("folder", F.concat("folder", F.lit("/"), (F.col("doc_id") % 9).cast("string")))
    present = listed.filter("doc_id % 9 <> 1 AND file_path IS NOT NULL").select("folder", F.col("file_path").alias("name"))
    return layout.list_compatibility(listed, present)


# Run totals ----------------------------------------------------------------------------------------


@query(
    "ag_11_run_totals", "taxon_results",
    "select count(*) as total_taxa, count(case when success then 1 end) as successful, count(case when not success then 1 end) as failed, cast(sum(case when success then files_found end) as bigint) as total_files, count(case when success then 1 end) / count(*)::double * 100 as success_rate, 120.0::double / count(*) as mean_seconds, count(*) / 120.0::double * 60 as taxa_per_minute from taxon_results",
)
def _(spark, sf):
    return reports.run_totals(derived(spark, sf, "taxon_results"), 120.0)


@query(
    "ag_12_batch_totals", "",
    "select cast(sum(case when ok then n end) as bigint) as total_files, count(case when ok then 1 end) as successful_batches, count(case when not ok then 1 end) as failed_batches, cast(sum(c) as bigint) as completed, cast(sum(n) as bigint) as expected, false as all_done"
    " from (select floor(o_orderkey / 100) as b, count(*) as n, count(case when o_orderstatus = 'F' then 1 end) as c, count(case when o_orderstatus = 'F' then 1 end) > 30 as ok from orders group by 1)",
)
def _(spark, sf):
    batches = given(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("batch")).agg(
        F.count("*").alias("files_saved"), F.count("*").alias("n_expected"), F.count_if(F.col("o_orderstatus") == "F").alias("n_completed")
    )
    return reports.batch_totals(batches.withColumn("success", F.col("n_completed") > 30))


# Levels --------------------------------------------------------------------------------------------

_HYSTERESIS = (
    "select entity, seq, cast(a1 + a2 + a3 as bigint) as level_rank, ['normal', 'warning', 'critical', 'paused'][a1 + a2 + a3 + 1] as level from ("
    "select entity, seq, "
    + ", ".join(
        f"coalesce(last_value(case when f < {limit}::double then 1 when not (f - 0.02::double < {limit}::double) then 0 end ignore nulls)"
        f" over (partition by entity order by seq rows between unbounded preceding and current row), 0) as a{k}"
        for k, limit in ((1, "0.2"), (2, "0.1"), (3, "0.05"))
    )
    + " from (select *, free_permille / 1000::double as f from metrics))"
)


def _metrics(spark, sf):
    return derived(spark, sf, "metrics")


@query("st_3_hysteresis_levels", "metrics", _HYSTERESIS)
def _(spark, sf):
    found = levels.hysteresis_levels(_metrics(spark, sf), ["entity"], [F.col("seq")], F.col("free_permille") / F.lit(1000.0))
    return found.select("entity", "seq", F.col("level_rank").cast("bigint").alias("level_rank"), "level")


@query("st_3_hysteresis_levels_ranged", "metrics", _HYSTERESIS)
def _(spark, sf):
    found = levels.hysteresis_levels(
        _metrics(spark, sf), ["entity"], [F.col("seq")], F.col("free_permille") / F.lit(1000.0), max_group_rows=10
    )
    return found.select("entity", "seq", F.col("level_rank").cast("bigint").alias("level_rank"), "level")
