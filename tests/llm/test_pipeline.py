"""The pipeline against plain Python versions of its stages, each on what the stage before it kept."""

from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_near_duplicates import brute as grouped
from test_pii import base
from test_tokens import check_packed, tokenizer  # noqa: F401  (a fixture)

import __spark_entry__ as entry_point
import corpus_pipeline
from cladeledger.llm import language_id
from cladeledger.workspace import materialize


def redacted(text):
    spans = sorted((a, b, k) for k, a, b in base(text))
    out, at, merged = [], 0, []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            last = merged[-1]
            merged[-1] = (last[0], max(b, last[1]), min(k, last[2]))
        else:
            merged.append((a, b, k))
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def test_stages(spark, sf, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    accepted = {r.doc_id for r in language_id.identify(docs, learn).filter("accepted").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for (name, stage), keep in zip(corpus_pipeline.STAGES[:3], (
        lambda rows: accepted,
        lambda rows: {c for _, _, c in grouped(sorted(rows.items()))},
        lambda rows: {r[0] for r in contaminated(list(rows.items()), items) if not r[5]},
    )):
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        wanted = keep(rows)
        rows = {i: t for i, t in rows.items() if i in wanted}
        assert {r.doc_id: r.text for r in docs.collect()} == rows
    docs = materialize(corpus_pipeline.redacted(spark, docs, sf), "redacted")
    assert docs.columns == columns
    rows = {i: redacted(t or "") for i, t in rows.items()}
    assert {r.doc_id: r.text or "" for r in docs.collect()} == rows
    check_packed(corpus_pipeline.packed(spark, docs, sf).collect(), list(rows.items()), tokenizer)
    check_packed(entry_point.queries()["pipeline"](spark, sf).collect(), list(rows.items()), tokenizer)


def test_empty_and_odd_documents(spark, sf):
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = "doc_id long, text string, lang string, source string, n_chars long"
    kinds = dict(some.dtypes)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0)], extra)
    odd = odd.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    for docs in (some.union(odd).withColumn("own_doc", F.lit("clash")), some.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns[:2] == ["doc_id", "piece"]
