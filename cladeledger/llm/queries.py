"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.llm import alignment, decontaminate, jaccard, language_id, licenses, neighbours, packing, pii, quality, simhash, token_files, url_filter, whitening
from cladeledger.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_files")
def _(spark, sf):
    manifest = token_files.write_sequences(table(spark, sf, "documents"), tokenizer_path(), end_id=1)
    return token_files.read_documents(manifest)


@query("op4_best_fit_packing")
def _(spark, sf):
    return packing.pack(packing.cut_pieces(table(spark, sf, "documents"), tokenizer_path(), end_id=0))


@query("op6_simhash")
def _(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_language_id")
def _(spark, sf):
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    found = language_id.identify(table(spark, sf, "documents"), learn)
    return found.select("doc_id", "held_out", "lang_pred", "score")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op3_decontamination",
    f"""
    with items as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
    windows as (
        select distinct item_id, list_slice(w, i, i + 9) as words
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
    ),
    texts as (select doc_id, {_WORDS} as w from documents),
    sizes as (select distinct len(words) as n from windows),
    places as (
        select doc_id, p, n, list_slice(w, p, p + n - 1) as words
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from texts, sizes)
    ),
    found as (select doc_id, p, n, item_id from places join windows using (words)),
    hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by 1),
    named as (
        select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
        from (select distinct doc_id, item_id from found) group by 1
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
    from texts left join hit using (doc_id) left join named using (doc_id)
    """,
)
def _(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("items")


@query("op9_personal_data")
def _(spark, sf):
    return pii.find(table(spark, sf, "documents"))


URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


@query(
    "op10_url_filter",
    r"""
    with parts as (
        select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
        from pages
    ),
    rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    fits as (
        select page_id, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
        from parts, rules where (host = h or host like '%.' || h) and starts_with(path, p) group by 1
    )
    select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parts left join fits using (page_id)
    """,
)
def _(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, url_filter.RULES))


@query("op7_neighbours")
def _(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_licence_scan", licenses.oracle())
def _(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query("op5_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


@query("op11_token_alignment")
def _(spark, sf):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf, "documents"), *paths)


@query("op12_ngram_jaccard")
def _(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@query("op13_embedding_whitening")
def _(spark, sf):
    return whitening.by_component(whitening.whiten(table(spark, sf, "embeddings")))
