import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladeledger.llm import packing, token_files
from cladeledger.llm.queries import QUERIES, tokenizer_path
from cladeledger.llm.tokens import WordEncoder
from cladeledger.workspace import new_path

TEXTS = st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("'’sStTre ĲÅΣσİ́ 中😀")), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path())


def test_fast_words_are_used(encoder):
    assert encoder._fast and encoder.dtype.itemsize == 2


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_the_tokenizers(tokenizer, encoder, text):
    assert next(encoder.encode_all([text])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "\n\n", "it's WE'LL'd", "a\x85b\xa0c\x1cd", "<|endoftext|> x <|startoftext|>", "x" * 5000, "1234567890²³", "é" * 300,
    "".join(map(chr, range(256))), " ".join(map(chr, range(256))), "é ẖ H̱ Å", "Σ ΑΣ", "日本語 text",
])
def test_odd_texts(tokenizer, encoder, text):
    assert next(encoder.encode_all([text])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = WordEncoder(path)
    assert not encoder._fast
    want = Tokenizer.from_file(path).encode("Hello  wörld\n", add_special_tokens=False).ids
    assert next(encoder.encode_all(["Hello  wörld\n"])).tolist() == want


def expected(rows, tokenizer, end):
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, ids))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_of_the_whole_table(spark, sf, tokenizer):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, sf).collect()}
    start = 0
    for doc_id, ids in expected(rows, tokenizer, 1):
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)


ODD = [(3, "b"), (1, None), (None, "no id"), (2, ""), (2, "Twice the id"), (2, "Twice the id"), (9, "long " * 3000), (-5, "first of all")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in ODD], "doc_id long, text string, start string, part int")


def tie(text):
    return xxhash.xxh64_intdigest(text.encode(), 42) - (xxhash.xxh64_intdigest(text.encode(), 42) >> 63 << 64)


def test_one_id_spans_parts(spark, tokenizer):
    """Nine tenths of the rows share an id; they still stand in one run and in several files."""
    rows = [(7 if i % 10 else i, f"text {i} " * 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_sequences(docs, tokenizer_path(), 1)
        got = token_files.read_documents(manifest).orderBy("start").collect()
        assert manifest.count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda r: (r[0], tie(r[1])))
    assert [r.ids_crc32 for r in got] == [crc(ids) for _, ids in expected(order, tokenizer, 1)]
    assert [r.doc_id for r in got] == [i for i, _ in order]


def test_files_of_odd_rows_and_random_access(spark, tokenizer):
    manifest = token_files.write_sequences(odd(spark), tokenizer_path(), 1, length=128, folder=new_path(spark, "odd"))
    got = [tuple(r)[:4] for r in token_files.read_documents(manifest).orderBy("start").collect()]
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or ""), r[1] or ""))
    want, start = [], 0
    for doc_id, ids in expected(order, tokenizer, 1):
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    for part in manifest.collect():
        reader = token_files.SequenceReader(f"{part.path}.arrow")
        whole = reader.span(0, part.tokens)
        for i in range(-(-part.tokens // 128)):
            ids, mask = reader.sequence(i)
            own = whole[i * 128 : (i + 1) * 128]
            assert ids[mask].tolist() == own.tolist() and mask.sum() == len(own) and not ids[~mask].any()
        assert not whole.flags.owndata or part.tokens > 64 * 128


def test_files_of_an_empty_table(spark):
    manifest = token_files.write_sequences(odd(spark).limit(0), tokenizer_path(), 1)
    assert manifest.count() == 0 and token_files.read_documents(manifest).count() == 0


# Packing -------------------------------------------------------------------------------------------


def check_plan(counts, capacity):
    plan = packing.Planner(counts, capacity)
    bins = {}
    used = dict.fromkeys(counts, 0)
    for length, rank, n, first, each, offset in sorted(plan.runs):
        assert rank == used[length]
        used[length] += n
        for i in range(n):
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert used == counts
    assert sorted(bins) == list(range(plan.sequences))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return plan


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=40))
def test_plan_places_every_piece_once(counts):
    plan = check_plan(counts, 40)
    total = sum(x * n for x, n in counts.items())
    # No two sequences could be one, as in any best fit.
    assert plan.sequences <= max(1, -(-2 * total // 40)) if total else plan.sequences == 0


@pytest.mark.parametrize("counts, sequences", [
    ({10: 4}, 4), ({6: 3, 4: 3}, 3), ({5: 4, 3: 4, 2: 4}, 4), ({4: 2, 3: 2, 2: 2, 1: 2}, 2), ({7: 1}, 1), ({}, 0), ({5: 5}, 3),
    ({3: 9}, 3), ({6: 2, 2: 4}, 2), ({1: 10}, 1),
])
def test_exact_complements(counts, sequences):
    assert check_plan(counts, 10).sequences == sequences


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(3)
    counts = {x: int(n) for x, n in zip(range(1, 2049), rng.integers(1, 50, 2048))}
    small, large = (packing.Planner({x: n * k for x, n in counts.items()}, 2048) for k in (1, 1_000_000))
    assert len(large.runs) < 2 * len(small.runs) < 40_000


def check_packed(rows, docs, tokenizer, capacity=2048):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want, total = {}, 0
    for doc_id, ids in expected(docs, tokenizer, 0):
        total += len(ids)
        for i, a in enumerate(range(0, len(ids), capacity)):
            want.setdefault(doc_id, []).append((i, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packing_of_the_whole_table(spark, sf, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check_packed(QUERIES["op4_best_fit_packing"](spark, sf).collect(), docs, tokenizer)
    assert n <= 1.02 * least + 1


def test_packing_of_odd_rows(spark, tokenizer):
    packed = packing.pack(packing.cut_pieces(odd(spark).repartition(3), tokenizer_path(), 0, capacity=64), capacity=64)
    check_packed(packed.collect(), ODD, tokenizer, 64)
    empty = packing.pack(packing.cut_pieces(odd(spark).limit(0), tokenizer_path(), 0))
    assert empty.count() == 0 and empty.columns == packed.columns
