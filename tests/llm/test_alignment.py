import hashlib
from collections import Counter
from functools import cache

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from cladeledger.llm import alignment
from cladeledger.llm.queries import QUERIES, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@cache
def byte_level(token):
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 256
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(extra)] = b
            extra += 1
    return bytes(table[c] for c in token)


class Plain:
    """Whole texts through both tokenizers, every pair of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def tokens(self, text):
        a = [(i, byte_level(self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            return [], []
        out = []
        for side in (a, b):
            at, spans = 0, []
            for i, data in side:
                spans.append((i, at, at + len(data)))
                at += len(data)
            out.append(spans)
        return out

    def rows(self, rows):
        found = []
        for doc_id, text in rows:
            a, b = self.tokens(text) if text else ([], [])
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            sides = [[[] for _ in cuts] for _ in range(2)]
            for side, spans in enumerate((a, b)):
                at = 0
                for i, _, end in spans:
                    while cuts[at] < end:
                        at += 1
                    sides[side][at].append(str(i))
            text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides))
            links, low = [], 0
            for i, s, e in a:
                while low < len(b) and b[low][2] <= s:
                    low += 1
                at = low
                while at < len(b) and b[at][1] < e:
                    links.append((i, b[at][0]))
                    at += 1
            found.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest() if cuts else ""))
        counts = Counter(p for *_, links, _ in found for p in set(links))
        most = {}
        for (i, _), c in counts.items():
            most[i] = max(most.get(i, 0), c)
        return sorted(
            (
                (d, na, nb, g, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest)
                for d, na, nb, g, links, digest in found
            ),
            key=str,
        )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_token_alignment"](spark, sf)) == Plain().rows(rows)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  \n\t "), (5, "a"), (5, "a"), (None, "a b"), (6, "foo\r bar\r\n  baz \r x"), (7, "a▁b"), (8, "mark ▁ alone"),
    (9, "<|endoftext|> <s> </s> <unk> <0x41>"), (10, "\u00a0x\u00a0 y\u2003 z\u3000  w"), (11, "naïve café ﬁ ① 日本語のテキスト。 한국어 🙂🙃👩‍👩‍👧"),
    (12, "e\u0301 \u0301 \u200b \ufeff"), (13, "\x00 \x1c\x1f !\x1c?"), (14, "x" * 5000), (15, "日本" * 3000), (16, " lead and trail  "), (17, "don't WON'T it's"),
    (18, "\n\nline\n line2 \n\n  indented\tx"), (19, "1234567890 3.14 ½ ²"), (20, "word " * 3000), (21, "\x85\u2028 \u2029a"),
]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in ODD], "doc_id int, text string, n_a int, codes string, times binary")
    want = Plain().rows(ODD)
    assert got(alignment.align(docs, *PATHS)) == want
    assert got(alignment.align(docs, *PATHS, shared_pairs=40)) == want
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_random_blanks(spark):
    rng = np.random.default_rng(1)
    kinds = [*alignment.BLANKS, "a", "Bc", "é", "!", "'s", "7", "日", "\x1d", "🙂"]
    rows = [(i, "".join(rng.choice(kinds, rng.integers(1, 40)).tolist())) for i in range(300)]
    assert got(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS)) == Plain().rows(rows)


def test_groups_are_runs_of_overlapping_intervals():
    starts, ends = np.array([0, 2, 5, 0, 3, 5, 6]), np.array([2, 5, 9, 3, 5, 6, 9])
    assert alignment.coalesce(starts, ends).tolist() == [0, 0, 1, 0, 0, 1, 1]
    left, right = alignment.overlaps(starts[:3], ends[:3], starts[3:], ends[3:])
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]


def test_tokenizers_that_merge_over_spaces_take_whole_texts():
    encoders = alignment.Encoders(*PATHS)
    assert encoders.units(" ab  cd\n e") == [" ab", "  cd\n e"]
    encoders.cuts = False
    assert encoders.units(" ab  cd\n e") == [" ab  cd\n e"]
