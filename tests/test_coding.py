import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockweave.operators import entropy, rle
from blockweave.plans import codec


def scanned(spark, v):
    return spark.createDataFrame([(0, 0, i, int(x)) for i, x in enumerate(v)], "frame_idx int, channel int, seq bigint, coef int")


@pytest.mark.parametrize("v,want", [([5, 0, 0, 0, -2, 0], [5, 0, 3, -2, 0, 1]), ([1, 2, 3], [1, 2, 3]), ([0] * 40000, [0, 32767, 0, 7233])])
def test_runs(spark, v, want):
    toks = rle.tokens(scanned(spark, v))
    got = [r.v for r in rle.stream(toks).orderBy("pos").collect()]
    assert got == want == codec.run_lengths(np.array(v, np.int64)).tolist()
    back = rle.untokens(toks).orderBy("seq").collect()
    assert [r.coef for r in back] == v and [r.seq for r in back] == list(range(len(v)))


def test_bytes_are_little_endian(spark):
    nums = spark.createDataFrame([(0, 0, 0, -2), (0, 0, 1, 258)], "frame_idx int, channel int, pos bigint, v int")
    assert [r.byte for r in rle.bytes_of(nums).orderBy("pos").collect()] == [254, 255, 2, 1]


def test_expanding_stops_at_what_there_is():
    assert codec.expand_runs(np.array([0, 2, 7, 0, 9]), 4).tolist() == [0, 0, 7, 0]
    assert codec.expand_runs(np.array([7, 0]), 3).tolist() == [7, 0, 0]
    assert codec.expand_runs(np.array([0, -3, 5]), 3).tolist() == [5, 0, 0]
    assert codec.expand_runs(np.array([], np.int64), 2).tolist() == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, -1, 300]), max_size=200))
def test_run_lengths_come_back(v):
    assert codec.expand_runs(codec.run_lengths(np.array(v, np.int64)).astype(np.int64), len(v)).tolist() == v


@pytest.mark.parametrize("data", [b"aaaa", b"ab" * 50, bytes(range(256)), b"x" * 70000 + b"yz", b"\0"])
def test_chunks_come_back(data):
    chunk = entropy.encode(data)
    assert entropy.decode(chunk, len(data)) == data
    assert np.frombuffer(chunk[:512], "<u2").max() <= 65535
    if len(set(data)) == 1:
        assert len(chunk) == 512 + -(-len(data) // 8)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_any_bytes_come_back(data):
    assert entropy.decode(entropy.encode(data), len(data)) == data


def test_deep_trees_and_short_chunks():
    data = b"".join(bytes([i]) * (1 << i) for i in range(15)) * 1 + bytes([200, 201, 202, 203])
    deep = bytes([255]) * 3 + data
    chunk = entropy.encode(deep)
    table = entropy.codes(np.frombuffer(chunk[:512], "<u2"))
    bits = np.unpackbits(np.frombuffer(chunk[512:], np.uint8))
    assert entropy._by_bit(table, bits, len(deep)) == deep == entropy.decode(chunk, len(deep))
    two = entropy.encode(b"aab")
    assert entropy.decode(two[:512], 3) == entropy._by_bit(entropy.codes(np.frombuffer(two[:512], "<u2")), np.zeros(0, np.uint8), 3)


def test_raw_blocks_come_back():
    block = np.linspace(-3, 900, 64, dtype=np.float32)
    assert (entropy.decode_block(entropy.encode_block(block)) == block).all()


def test_tree_order_by_hand():
    counts = np.zeros(256, np.uint16)
    counts[[1, 2, 3, 4]] = [5, 5, 3, 4]
    # 3 and 4 join in 3's place and 2... the list is then [1, 2, (3 4)]; 1 and 2 tie, the first in the list leads
    assert entropy.codes(counts) == {1: (2, 2), 2: (2, 3), 3: (2, 0), 4: (2, 1)}


def test_bad_chunks():
    with pytest.raises(entropy.CorruptChunk):
        entropy.decode(b"short", 1)
    with pytest.raises(entropy.CorruptChunk):
        entropy.decode(bytes(512), 1)
    with pytest.raises(entropy.CorruptChunk):
        entropy.encode(b"")


def test_scaled_histogram(spark):
    h = spark.createDataFrame([(1, 131070), (2, 1), (3, 65535)], "byte int, n bigint")
    assert {r.byte: r.freq for r in entropy.scaled(h).collect()} == {1: 65535, 2: 1, 3: 32767}


def test_spark_functions(spark):
    df = spark.createDataFrame([(b"hello world",), (b"",), (None,)], "d binary")
    got = df.select("d", entropy.huffman_decode(entropy.huffman_encode("d"), F.length("d")).alias("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [b"hello world", None, None]
