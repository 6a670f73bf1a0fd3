"""Best-fit packing of tokenised documents by hierarchical residual merging."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Chunks between these six characters are tokenised alone: the tokenizer's words never span white space.
_SPACE = " \t\n\r\x0b\x0c"
_memo: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_tokenizers: dict[str, tuple] = {}

MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_MEMBER_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
_OUT = pa.schema([("leaf", pa.int64()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("room", pa.int32()), ("members", _MEMBER_TYPE)])


class TextTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, with each distinct chunk and word tokenised once.

    A chunk between white space is looked up first. A new chunk of printable ASCII and accented Latin letters is
    split into the tokenizer's own words, and only new words reach the tokenizer, many in one call; any other
    chunk goes to the tokenizer whole. Both memories are emptied when full, so they stay bounded.
    """

    _plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    _words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, remember: int = 700_000, longest: int = 40) -> None:
        if path not in _tokenizers:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, normalizers, pre_tokenizers

            tok = Tokenizer.from_file(path)
            vocab = tok.get_vocab()
            ends = np.zeros(max(vocab.values()) + 1, bool)
            ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
            # for words that are normalised and cut already: the same merges without those steps
            plain = Tokenizer.from_file(path)
            plain.normalizer = normalizers.Sequence([])
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            _tokenizers[path], _memo[path] = (tok, plain, ends), ({}, {})
        (self.tok, self.merges, self.ends), (self.memo, self.words) = _tokenizers[path], _memo[path]
        self.remember, self.longest = remember, longest

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words of letters only go as one text: each is one word of the tokenizer, and its last id ends a word."""
        letters = [w for w in words if w.isalpha()]
        if letters:
            ids = np.array(self.merges.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(letters):  # another kind of tokenizer
                self.words.update(zip(letters, self._encode(letters)))
            else:
                raw, stops = ids.tobytes(), stops.tolist()
                self.words.update((w, raw[s:e]) for w, s, e in zip(letters, [0, *stops], stops))
        rest = [w for w in words if not w.isalpha()]
        if rest:
            self.words.update(zip(rest, self._encode(rest)))

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        if len(self.words) > self.remember:
            self.words.clear()
        plain = {c: self._words.findall(c.lower()) for c in chunks if self._plain.fullmatch(c) and "<|" not in c}
        words = self.words
        if new := list({w for ws in plain.values() for w in ws if w not in words}):
            self._learn(new)
        found = {c: b"".join([words[w] for w in ws]) for c, ws in plain.items()}
        if rest := [c for c in chunks if c not in plain]:
            found.update(zip(rest, self._encode(rest)))
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        for c in _SPACE[1:]:
            text = text.replace(c, " ")
        chunks, memo = text.split(" "), self.memo
        try:
            return b"".join(map(memo.__getitem__, chunks))
        except KeyError:
            pass
        if len(memo) > self.remember:
            memo.clear()
        found = self._new([c for c in set(chunks) if c not in memo])
        memo.update((c, b) for c, b in found.items() if len(c) <= self.longest)
        return b"".join([found[c] if c in found else memo[c] for c in chunks])


def pieces_of(ids: bytes, limit: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, cut only if they are more than ``limit``."""
    n, step = len(ids) // 4, limit * 4
    return [(k, k * limit, min(limit, n - k * limit), zlib.crc32(ids[k * step : (k + 1) * step])) for k in range(max(1, -(-n // limit)))]


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers. Items in the given order go into the fullest bin that still holds them.

    The open bins stand by free room in ``limit + 1`` stacks; a bit set of the stacks in use finds the fullest fit.
    """
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    used, bins = 0, []
    for i, s in enumerate(sizes):
        fits = used >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                used &= ~(1 << room)
        else:
            room, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        if room - s:
            stacks[room - s].append(b)
            used |= 1 << (room - s)
    return bins


def _merge(items: list[tuple[int, list[dict]]], limit: int) -> list[tuple[int, list[dict]]]:
    """Best fit, largest first, of bins (fill, members); the order, and so the result, hangs on the items alone."""
    items.sort(key=lambda x: (-x[0], x[1][0]["doc_id"] is None, x[1][0]["doc_id"] or 0, x[1][0]["piece"], x[1][0]["ids_crc32"]))
    out = []
    for b in best_fit([x[0] for x in items], limit):
        at, members = 0, []
        for i in b:
            fill, own = items[i]
            members += [m | {"offset": m["offset"] + at} for m in own] if at else own
            at += fill
        out.append((at, members))
    return out


def _table(bins: list[tuple[int, list[dict]]], leaf: int, seq: int, limit: int) -> pa.Table:
    """Bins with their numbers; ``room`` numbers those that aren't full among the ones of the same fill."""
    same: Counter[int] = Counter()
    room: list[int | None] = []
    for fill, _ in bins:
        room.append(same[fill] if fill < limit else None)
        same[fill] += 1
    return pa.Table.from_arrays(
        [pa.array([leaf] * len(bins), pa.int64()), pa.array([seq + i for i in range(len(bins))], pa.int64()), pa.array([f for f, _ in bins], pa.int32()), pa.array(room, pa.int32()), pa.array([m for _, m in bins], _MEMBER_TYPE)], schema=_OUT
    )


def _node(r: int, limit: int, fan_in: int):
    def node(t):  # pa.Table to pa.Table; the kind of function is told from its arguments
        items = list(zip(t.column("fill").to_pylist(), t.column("members").to_pylist()))
        leaf = t.column("leaf")[0].as_py() // fan_in
        return _table(_merge(items, limit), leaf, (r << 56) + (leaf << 32), limit)

    return node


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, fan_in: int = 8) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each partition tokenises its documents and packs them best-fit, largest first. Full bins keep their number. What
    is left, underfull bins with their members, goes up a tree: every round packs the bins of ``fan_in``
    neighbouring nodes as items; the last round numbers whatever remains.

    Best fit leaves no two bins of a node that would fit together, so at most one that is half empty. In
    each round above it, then, a node's bins can take at most one bin of each of ``fan_in`` neighbours. So of the bins of one fill as
    many go up as there are rounds to come times ``fan_in``; the others can't be needed and keep their number, and
    the result is the one that all bins would give. What a node hands up is bounded by ``limit``, the fan-in and the depth, not by the
    data. Each node's result depends on its rows only, not on their order, so a lost task is repeated exactly.

    Null and empty texts are a document of one token (``end_id``). Repeated rows are packed as often as they
    occur; a null doc_id is kept; no rows give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    out = f"leaf long, sequence_id long, fill int, room int, members {MEMBER}"
    tail = np.array([end_id], "<u4").tobytes()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, leaf = TextTokenizer(tokenizer), TaskContext.get().partitionId()
        items = []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                for k, start, n, crc in pieces_of(tok.ids(t.as_py()) + tail, limit):
                    items.append((n, [{"doc_id": i, "piece": k, "start": start, "length": n, "ids_crc32": crc, "offset": 0}]))
        yield from _table(_merge(items, limit), leaf, leaf << 32, limit).to_batches()

    state = scratch.write(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(local, out))
    nodes, whole, r = (state.agg(F.max("leaf")).first()[0] or 0) + 1, None, 0
    rounds = 0
    while fan_in**rounds < nodes:
        rounds += 1
    while True:
        up = F.coalesce(F.col("room") < fan_in * (rounds - r), F.lit(False))
        done, rest = state.where(~up), state.where(up)
        whole = done if whole is None else whole.unionByName(done)
        if r == rounds:
            break
        r += 1
        state = scratch.write(rest.groupBy(F.floor(F.col("leaf") / fan_in)).applyInArrow(_node(r, limit, fan_in), out))
    return whole.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
