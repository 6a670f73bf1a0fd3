"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.tables import quant_table
from ..operators import blocks, entropy, metrics, rle, temporal, transform
from ..sources import images
from ..sources.rasters import HEIGHT, WIDTH, embed_blocks, interleaved, line_rgb, table
from . import codec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _spread(df: DataFrame, values: str, name: str, digits: int | None = None) -> DataFrame:
    """A row for each of a block's 64 values."""
    rows = df.select("frame_idx", "channel", "block_id", F.posexplode(values).alias("pos", name))
    return rows.withColumn(name, F.round(name, digits) + 0.0) if digits is not None else rows


def _shifted(s: SparkSession, d: str) -> DataFrame:
    return blocks.level_shift(embed_blocks(s, d), -128.0)


def _coefs(s: SparkSession, d: str) -> DataFrame:
    return _shifted(s, d).select("frame_idx", "channel", "block_id", transform.dct("px").alias("c"))


def _embed_n(s: SparkSession, d: str) -> DataFrame:
    return transform.quantise(_coefs(s, d)).drop("c")


def _embed_d(s: SparkSession, d: str) -> DataFrame:
    return temporal.residual(_embed_n(s, d)).drop("n")


def _line_blocks(s: SparkSession, d: str) -> DataFrame:
    return blocks.tile(blocks.planes(line_rgb(s, d)), WIDTH, HEIGHT)


def _line_n(s: SparkSession, d: str) -> DataFrame:
    c = blocks.level_shift(_line_blocks(s, d), -128.0)
    return transform.quantise(c.select("frame_idx", "channel", "block_id", transform.dct("px").alias("c"))).drop("c")


def _line_d(s: SparkSession, d: str) -> DataFrame:
    return temporal.residual(_line_n(s, d)).drop("n")


def _restored(n: DataFrame, quality: int = 50) -> DataFrame:
    c = transform.dequantise(n, quality)
    return blocks.level_shift(c.select("frame_idx", "channel", "block_id", transform.idct("c").alias("px")), 128.0)


def _scanned(d: DataFrame) -> DataFrame:
    return rle.scan(d.select("frame_idx", "channel", "block_id", transform.permute("d").alias("z")), "z")


@query
def rgb_to_ycbcr(s: SparkSession, d: str) -> DataFrame:
    return blocks.ycbcr(line_rgb(s, d)).select("frame_idx", "y", "x", *[F.round(c, 6).alias(c) for c in ("luma", "cb", "cr")])


@query
def chroma_subsample(s: SparkSession, d: str) -> DataFrame:
    return blocks.subsample(blocks.ycbcr(line_rgb(s, d))).select("frame_idx", "y", "x", F.round("cb", 6).alias("cb"), F.round("cr", 6).alias("cr"))


@query
def ycbcr_roundtrip(s: SparkSession, d: str) -> DataFrame:
    full = blocks.ycbcr(line_rgb(s, d)).select("frame_idx", "y", "x", *[F.round(c, 6).alias(c) for c in ("luma", "cb", "cr")])
    return blocks.restore_rgb(full.drop("cb", "cr"), blocks.subsample(full))


@query
def raw_planes(s: SparkSession, d: str) -> DataFrame:
    """Interleaved bytes taken apart again: byte position to pixel and channel."""
    b = interleaved(line_rgb(s, d)).select("frame_idx", F.posexplode(F.regexp_extract_all(F.hex("data"), F.lit("(..)"), 1)).alias("at", "h"))
    pixel = F.floor(F.col("at") / 3)
    return b.select("frame_idx", (F.col("at") % 3).alias("channel"), F.floor(pixel / WIDTH).cast("int").alias("y"), (pixel % WIDTH).cast("int").alias("x"), F.conv("h", 16, 10).cast("int").alias("v"))


@query
def pad_and_tile(s: SparkSession, d: str) -> DataFrame:
    return _spread(_line_blocks(s, d), "px", "v", 6)


@query
def untile(s: SparkSession, d: str) -> DataFrame:
    return blocks.untile(_line_blocks(s, d), WIDTH, HEIGHT).select("frame_idx", "channel", "y", "x", F.round("v", 6).alias("v"))


@query
def level_shift(s: SparkSession, d: str) -> DataFrame:
    return _spread(_shifted(s, d), "px", "v")


@query
def dct_blocks(s: SparkSession, d: str) -> DataFrame:
    return _spread(_coefs(s, d), "c", "coef", 5)


@query
def idct_roundtrip(s: SparkSession, d: str) -> DataFrame:
    back = _coefs(s, d).select("frame_idx", "channel", "block_id", transform.idct("c").alias("px"))
    return _spread(back, "px", "v", 5)


@query
def quant_matrix(s: SparkSession, d: str) -> DataFrame:
    rows = [(q, name, F.array(*map(F.lit, quant_table(q, name == "luma")))) for q in (10, 50, 90, 100) for name in ("luma", "chroma")]
    one = s.range(1)
    parts = F.array(*[F.struct(F.lit(q).alias("quality"), F.lit(n).alias("tbl"), t.alias("t")) for q, n, t in rows])
    return one.select(F.inline(parts)).select("quality", "tbl", F.posexplode("t").alias("pos", "q"))


@query
def quantize(s: SparkSession, d: str) -> DataFrame:
    return _spread(_embed_n(s, d), "n", "n")


@query
def quantize_line(s: SparkSession, d: str) -> DataFrame:
    return _spread(_line_n(s, d), "n", "n")


@query
def dequantize(s: SparkSession, d: str) -> DataFrame:
    return _spread(transform.dequantise(_embed_n(s, d)), "c", "c")


@query
def temporal_residual(s: SparkSession, d: str) -> DataFrame:
    return _spread(_embed_d(s, d), "d", "d")


@query
def temporal_residual_line(s: SparkSession, d: str) -> DataFrame:
    return _spread(_line_d(s, d), "d", "d")


@query
def temporal_reconstruct(s: SparkSession, d: str) -> DataFrame:
    return _spread(temporal.reconstruct(_embed_d(s, d)), "n", "n")


@query
def permute_scan(s: SparkSession, d: str) -> DataFrame:
    return _spread(_embed_n(s, d).select("frame_idx", "channel", "block_id", transform.permute("n").alias("z")), "z", "coef")


@query
def inverse_scan(s: SparkSession, d: str) -> DataFrame:
    there = _embed_n(s, d).select("frame_idx", "channel", "block_id", transform.permute("n").alias("z"))
    return _spread(there.select("frame_idx", "channel", "block_id", transform.unpermute("z").alias("n")), "n", "n")


@query
def rle_tokens(s: SparkSession, d: str) -> DataFrame:
    return rle.tokens(_scanned(_embed_d(s, d)))


@query
def rle_tokens_line(s: SparkSession, d: str) -> DataFrame:
    return rle.tokens(_scanned(_line_d(s, d)))


@query
def rle_decode(s: SparkSession, d: str) -> DataFrame:
    return rle.untokens(rle.tokens(_scanned(_embed_d(s, d))))


@query
def rle_stats(s: SparkSession, d: str) -> DataFrame:
    t = rle.tokens(_scanned(_embed_d(s, d)))
    return t.groupBy("frame_idx", "channel").agg(F.count("*").alias("tokens"), F.sum(F.when(F.col("run").isNull(), 1).otherwise(2)).alias("numbers"), F.sum("value").alias("total"), F.coalesce(F.max("run"), F.lit(0)).alias("longest"))


@query
def rle_bytes(s: SparkSession, d: str) -> DataFrame:
    return rle.bytes_of(rle.stream(rle.tokens(_scanned(_embed_d(s, d)))))


def _text_bytes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


@query
def byte_histogram(s: SparkSession, d: str) -> DataFrame:
    return entropy.byte_histogram(_text_bytes(s, d), "data")


@query
def scaled_histogram(s: SparkSession, d: str) -> DataFrame:
    return entropy.scaled(entropy.byte_histogram(_text_bytes(s, d), "data"))


@query
def byte_entropy(s: SparkSession, d: str) -> DataFrame:
    h = entropy.byte_histogram(_text_bytes(s, d), "data", ["doc_id"])
    total = h.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return h.join(total, "doc_id").groupBy("doc_id").agg(F.round(entropy.entropy_bits(F.col("n"), F.col("total")), 6).alias("bits"))


@query
def huffman_code_lengths(s: SparkSession, d: str) -> DataFrame:
    h = entropy.scaled(entropy.byte_histogram(_text_bytes(s, d), "data"))
    counts = h.agg(F.map_from_entries(F.collect_list(F.struct("byte", "freq"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return counts.select(F.inline(entropy.huffman_codes(whole))).select("byte", "length", "bits")


@query
def huffman_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Each text through its own chunk and back; the SQL counterpart is the table itself."""
    t = _text_bytes(s, d).where("length(data) > 0")
    back = t.select("doc_id", F.decode(entropy.huffman_decode(entropy.huffman_encode("data"), F.length("data").cast("int")), "UTF-8").alias("text"))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def huffman_ratio(s: SparkSession, d: str) -> DataFrame:
    t = _text_bytes(s, d).where("length(data) > 0").select("doc_id", F.length("data").alias("raw"), F.length(entropy.huffman_encode("data")).alias("coded"))
    return t.select("doc_id", "raw", "coded", F.round(F.col("raw") / F.col("coded"), 6).alias("ratio"))


@query
def mse(s: SparkSession, d: str) -> DataFrame:
    keys = ["frame_idx", "channel", "block_id", "pos"]
    a, b = _spread(embed_blocks(s, d), "px", "v"), _spread(_restored(_embed_n(s, d)), "px", "v", 6)
    return metrics.mse(a, b, keys, ["frame_idx"]).select("frame_idx", F.round("mse", 5).alias("mse"))


@query
def psnr_by_frame(s: SparkSession, d: str) -> DataFrame:
    """Of the line raster's planes before and after, padding left out."""
    keys = ["frame_idx", "channel", "y", "x"]
    a = blocks.untile(_line_blocks(s, d), WIDTH, HEIGHT)
    b = blocks.untile(_restored(_line_n(s, d)), WIDTH, HEIGHT)
    m = metrics.mse(a, b, keys, ["frame_idx"])
    return m.select("frame_idx", F.round("mse", 5).alias("mse"), F.round(metrics.psnr(F.col("mse")), 5).alias("psnr"))


@query
def codec_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the line raster."""
    c = codec.encode(interleaved(line_rgb(s, d)), WIDTH, HEIGHT)
    return c.select("frame_idx", "channel", "rle_bytes", "enc_len", F.md5("payload").alias("payload_md5"))


@query
def codec_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The line raster through chunks and back, against itself."""
    from ..sources.container import Header

    frames = interleaved(line_rgb(s, d))
    back = codec.decode(codec.encode(frames, WIDTH, HEIGHT), Header(WIDTH, HEIGHT, 3, 50, 0, 1))
    px = lambda f: f.select("frame_idx", F.posexplode(F.regexp_extract_all(F.hex("data"), F.lit("(..)"), 1)).alias("at", "h")).select("frame_idx", "at", F.conv("h", 16, 10).cast("int").alias("v"))
    return metrics.mse(px(frames), px(back), ["frame_idx", "at"], ["frame_idx"]).select("frame_idx", F.round("mse", 2).alias("mse"))


def _profile_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").select(F.col("event_type").alias("fn"), F.col("value").cast("string").alias("duration_us"), k.alias("compute_pct"), F.lit("0").alias("memory_pct"), k.alias("registers"))


@query
def profile_summary(s: SparkSession, d: str) -> DataFrame:
    out = metrics.profile_summary(metrics.profile(_profile_rows(s, d)))
    return out.select(scalars.display_name(F.col("fn")).alias("name"), "calls", *[F.round(c, 4).alias(c) for c in ("total", "avg_duration", "avg_compute", "avg_memory")], "registers")


@query
def profile_total(s: SparkSession, d: str) -> DataFrame:
    return metrics.profile(_profile_rows(s, d)).agg(F.round(F.sum("duration"), 4).alias("total"))


def _timings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("backend"), F.col("o_totalprice").alias("seconds"))


@query
def benchmark_summary(s: SparkSession, d: str) -> DataFrame:
    m = metrics.timing_summary(_timings(s, d))
    return metrics.in_order(m, ["1-URGENT", "2-HIGH"]).select("backend", F.round("avg_s", 4).alias("avg_s"), "min_s", "runs")


@query
def speedup(s: SparkSession, d: str) -> DataFrame:
    return metrics.speedup(metrics.timing_summary(_timings(s, d)), "1-URGENT").select("backend", F.round("speedup", 6).alias("speedup"))


@query
def parse_float_tolerant(s: SparkSession, d: str) -> DataFrame:
    """Numbers as they come, with decimal commas, in quotes, and what isn't a number."""
    e = table(s, d, "events")
    v = F.regexp_replace(F.format_string("%.2f", "value"), r"\.", ",")
    raw = F.element_at(F.array(F.col("value").cast("decimal(18,4)").cast("string"), v, F.concat(F.lit('" '), v, F.lit(' "')), F.concat(F.lit("1,"), v), F.lit("n/a"), F.lit("1d"), F.lit("1_0")), (F.col("event_id") % 7 + 1).cast("int"))
    p = e.select("event_id", raw.alias("raw"))
    return p.select("event_id", scalars.parse_float(F.col("raw")).alias("number"), scalars.parse_int(F.col("raw")).alias("whole"))


@query
def numeric_name_order(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.col("p_brand").alias("name")).unionByName(table(s, d, "customer").select(F.col("c_name").alias("name"))).distinct()
    return names.select("name", scalars.first_number(F.col("name")).cast("long").alias("number")).orderBy("number", "name")


@query
def frame_manifest(s: SparkSession, d: str) -> DataFrame:
    """Pages' paths as file names, every third an image, numbered like a folder of frames."""
    ext = F.element_at(F.array(F.lit(".PNG"), F.lit(".jpeg"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    return images.manifest(table(s, d, "pages").select(F.concat("url", F.lit("/"), F.col("page_id").cast("string"), ext).alias("path")))


@query
def code_bit_offsets(s: SparkSession, d: str) -> DataFrame:
    """Where each byte's code starts in its text's chunk: a running sum of code lengths."""
    from pyspark.sql import Window

    codes = huffman_code_lengths(s, d).select("byte", "length")
    t = _text_bytes(s, d).select("doc_id", F.posexplode(F.regexp_extract_all(F.hex("data"), F.lit("(..)"), 1)).alias("at", "h"))
    t = t.select("doc_id", "at", F.conv("h", 16, 10).cast("int").alias("byte")).join(F.broadcast(codes), "byte")
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).groupBy("doc_id").agg(F.sum("length").alias("bits"), F.max("offset").alias("last_offset"), F.count("*").alias("codes"))
