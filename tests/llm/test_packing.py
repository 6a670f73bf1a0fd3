import functools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from blockweave.llm import packing
from blockweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "", None, " ", "Hello, world! it's we'll 12 3.5 <|endoftext|> x", "ÉÀ ß straße İstanbul Ωσ é ñ ́x", "a b c 日本語 テスト ½ ²", "'s!'s '' 'tis don't ###$$$ x_y",
    "x" * 5000, "tab\there\nnew\x0bv\x0cf\r\n end", "× ÷ ªº µ", "The the THE loweiä QUE!! a|b",
]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(text):
    for _ in range(2):
        assert packing.TextTokenizer(tokenizer_path()).ids(text) == np.array(ids(text), "<u4").tobytes()


def test_best_fit_takes_the_fullest():
    assert packing.best_fit([6, 5, 4, 5], 10) == [[0, 2], [1, 3]]
    assert packing.best_fit([10, 7, 8, 2, 3], 10) == [[0], [1, 4], [2, 3]]


def check(rows, out, limit):
    want = {}
    for d, t in rows:
        own = [*ids(t), 0]
        for k in range(-(-len(own) // limit)):
            part = own[k * limit : (k + 1) * limit]
            key = (d, k, k * limit, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got, bins = {}, {}
    for r in out:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit
    return len(bins), sum(k[3] * n for k, n in want.items())


@pytest.mark.parametrize("parts,limit", [(1, 2048), (20, 64), (9, 64)])
def test_whole_documents_come_back(spark, parts, limit):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 90)))) for i in range(300)] + list(enumerate(TEXTS)) + [(None, "x"), (None, "x"), (5, "same"), (5, "same")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(parts).selectExpr("*", "1 as piece", "2 as leaf", "3 as room")
    n, total = check(rows, packing.pack(df, tokenizer_path(), limit=limit).collect(), limit)
    assert n <= 1.03 * total / limit + 2


@pytest.mark.parametrize("low,high", [(1, 60), (30, 60), (34, 50), (1, 20)])
def test_no_bin_is_lost_by_leaving_fuller_ones_behind(spark, low, high):
    """As many sequences as when every bin goes up the whole tree."""
    rng, limit = np.random.default_rng(low), 64
    rows = [(i, " ".join(["word"] * int(rng.integers(low, high)))) for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(17, "doc_id")
    parts = {}
    for r in df.selectExpr("doc_id", "spark_partition_id() as p").collect():
        parts.setdefault(r.p, []).append(len(ids(rows[r.doc_id][1])) + 1)
    level = [parts.get(p, []) for p in range(17)]
    fold = lambda sizes: [sum(own) for own in ([sorted(sizes, reverse=True)[i] for i in b] for b in packing.best_fit(sorted(sizes, reverse=True), limit))]
    level = [fold(x) for x in level]
    while len(level) > 1:
        level = [fold([s for x in level[k : k + 8] for s in x]) for k in range(0, len(level), 8)]
    out = packing.pack(df, tokenizer_path(), limit=limit).collect()
    assert len({r.sequence_id for r in out}) == len(level[0])


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
