"""Token ids in Re-Pair compressed shards, readable at random.

Documents are dealt to partitions by ranges of doc_id, encoded in order and cut into shards of about `shard_ids` ids, a
document never being split. In a shard the frequent pairs of neighbouring symbols are replaced by new symbols, round
after round: a round takes the `step` most frequent pairs and replaces their occurrences at once; where occurrences
overlap, the more frequent pair wins, and the other waits for the next round. After the first round only the places are
counted again where a pair is frequent or a symbol is new. It ends when no pair occurs `least` times: twice, that is.

A shard file holds its rules with the number of ids that each expands to, the symbols that are left, the number of ids
before every `BLOCK`-th symbol, and the documents with their places, so `read_span` expands only what it is asked for.

Layout, little-endian: MAGIC; 8 x uint64: partition, shard in it, documents, ids, symbols, rules, first rule's symbol,
blocks; rules' left and right (uint32 each) and expansion lengths (uint32); block starts (uint64); symbols (3 bytes
each); doc ids (int64; the null id is -2^63); document starts in the shard (uint64, one more than documents).

Null texts are empty: the end id alone. Repeated rows are kept one by one; null ids come first. No rows, no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import filesystem, forget, kept, new_folder, put_file, texts, tidy, written
from quire.llm.tokens import Encoder

MAGIC = b"RPAIRIDS"
BLOCK = 256
NULL_ID = -(2**63)
#: From one place in so many on, places are marked rather than sorted.
MANY = 32


def _sorted(high: np.ndarray, low: np.ndarray, low_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Both by high, then low. Where they fit into 64 bits together they are sorted as one number, which is much faster."""
    bits = int(low_max).bit_length()
    if len(high) and int(high.max()).bit_length() + bits > 64:
        order = np.lexsort((low, high))
        return high[order], low[order]
    both = high << np.uint64(bits)
    both |= low.astype(np.uint64)
    both.sort()
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _frequent(x: np.ndarray, after: np.ndarray, top: int, places: np.ndarray, least: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(up to `step` pairs that occur `least` times or more, as left << 32 | right, the most frequent first; the places
    where they occur, in order; which one does; the places of all pairs that occur so often).

    after: where the symbol behind each one stands; top: above all symbols; places: where such pairs can be.
    """
    bits = np.uint64(top.bit_length())
    keys, places = _sorted((x[places].astype(np.uint64) << bits) | x[after[places]], places, len(x))
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    often = np.flatnonzero(counts >= least)
    many = counts[often]
    top = int(many.max(initial=0))
    chosen = _sorted((top - many).astype(np.uint64), often, len(counts))[1][:step]
    number = np.full(len(counts), -2, np.int32)
    number[often] = -1
    number[chosen] = np.arange(len(chosen), dtype=np.int32)
    number = np.repeat(number, counts)
    hit = np.flatnonzero(number >= 0)
    if len(hit) > len(x) // MANY:  # by place without sorting
        which = np.full(len(x), -1, np.int32)
        which[places[hit]] = number[hit]
        at = np.flatnonzero(which >= 0)
        got = which[at]
    else:
        at, got = _sorted(places[hit].astype(np.uint64), number[hit], max(len(chosen), 1))
    pairs = keys[first[chosen]]
    return pairs >> bits << np.uint64(32) | pairs & np.uint64((1 << int(bits)) - 1), at.astype(np.int64), got, places[number > -2]


def compress(ids: np.ndarray, least: int = 2, step: int = 65_536, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, rules' lefts, rights, expansion lengths, the first rule's symbol). With `most` symbols no more are made; a shard
    of the usual 1,000,000 ids makes less than half a million."""
    x, n = ids.astype(np.uint32), len(ids)
    base = top = int(x.max(initial=0)) + 1
    lefts, rights, size = [], [], np.ones(2 * base, np.uint32)
    # symbols stay where they are, linked to the ones before and behind them, so a round costs what it replaces
    after, before, there = np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool)
    places = np.arange(max(n - 1, 0))
    while len(places):
        pairs, at, got, often = _frequent(x, after, top, places, least, min(step, most - top))
        if not len(pairs):
            break
        # of overlapping occurrences the more frequent pair's stays; in a run of one pair, the first
        near = np.r_[False, at[1:] == after[at[:-1]]]
        loses = near & (np.r_[0, got[:-1]] <= got)
        loses |= np.r_[near[1:], False] & (np.r_[got[1:], 0] < got)
        at, got = at[~loses], got[~loses]
        used = np.bincount(got, minlength=len(pairs)) > 0
        symbol = np.cumsum(used) - 1 + top
        pair = pairs[used]
        left, right = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
        lefts.append(left)
        rights.append(right)
        if top + len(left) > len(size):
            size = np.concatenate([size, np.zeros(max(len(size), len(left)), np.uint32)])
        size[top : top + len(left)] = size[left] + size[right]
        top += len(left)
        x[at] = symbol[got]
        gone = after[at]
        there[gone] = False
        after[at] = after[gone]
        before[after[gone]] = at
        # counts of other pairs only fall, so from here on look at those that are still frequent, and around new symbols
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        if len(often) + len(at) > n // MANY:
            some = np.zeros(n, bool)
            some[often] = some[at] = some[ahead] = True
            places = np.flatnonzero(some & there)
        else:
            places = np.concatenate([often, at, ahead])
            places.sort()
            places = places[np.append(True, places[1:] != places[:-1])]
            places = places[there[places]]
        places = places[after[places] < n]
    x = x[there]
    none = np.zeros(0, np.uint32)
    return x, np.concatenate(lefts or [none]), np.concatenate(rights or [none]), size[base:top].copy(), base


def expand(symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: all symbols of one depth at once, each at the place that the lengths give it."""
    inner = symbols >= base
    n = np.ones(len(symbols), np.int64)
    n[inner] = sizes[symbols[inner] - base]
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    while len(symbols):
        inner = symbols >= base
        out[at[~inner]] = symbols[~inner]
        rule, at = symbols[inner] - base, at[inner]
        left, right = lefts[rule], rights[rule]
        behind = np.ones(len(left), np.int64)
        deep = left >= base
        behind[deep] = sizes[left[deep] - base]
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + behind])
    return out


def shard_bytes(part: int, shard: int, docs: list, ids: np.ndarray, starts: np.ndarray, **how) -> bytes:
    x, lefts, rights, sizes, base = compress(ids, **how)
    n = np.ones(len(x), np.int64)
    n[x >= base] = sizes[x[x >= base] - base]
    blocks = np.r_[0, np.cumsum(n)][:-1][::BLOCK].astype("<u8")
    head = np.array([part, shard, len(docs), len(ids), len(x), len(lefts), base, len(blocks)], "<u8")
    packed = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    doc_ids = np.array([NULL_ID if d is None else d for d in docs], "<i8")
    return b"".join([MAGIC, head.tobytes(), lefts.astype("<u4").tobytes(), rights.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), blocks.tobytes(), packed.tobytes(), doc_ids.tobytes(), starts.astype("<u8").tobytes()])


class Shard:
    """A shard file's content; ids are expanded when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.part, self.shard, docs, self.n_ids, symbols, rules, self.base, blocks = np.frombuffer(data, "<u8", 8, 8).astype(np.int64).tolist()
        at = 72

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.lefts, self.rights, self.sizes, self.blocks = take("<u4", rules), take("<u4", rules), take("<u4", rules), take("<u8", blocks)
        wide = np.zeros((symbols, 4), np.uint8)
        wide[:, :3] = take("u1", 3 * symbols).reshape(-1, 3)
        self.symbols = wide.view("<u4").reshape(-1)
        self.doc_ids, self.starts = take("<i8", docs), take("<u8", docs + 1).astype(np.int64)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.lefts, self.rights, self.sizes, self.base)

    def read_span(self, start: int, length: int) -> np.ndarray:
        """`length` ids from the shard's id `start` on, from the blocks that hold them alone."""
        first = max(0, int(np.searchsorted(self.blocks, start, "right")) - 1)
        last = int(np.searchsorted(self.blocks, start + length, "left"))
        got = expand(self.symbols[first * BLOCK : max(last, first + 1) * BLOCK], self.lefts, self.rights, self.sizes, self.base)
        skip = start - int(self.blocks[first]) if len(self.blocks) else 0
        return got[skip : skip + length]


def write_shards(docs: DataFrame, folder: str, file: str, end_id: int, spaced: bool, shard_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Writes the shards of all documents into folder; one row for each file: part, shard, path, n_docs, n_ids, n_bytes."""

    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), kept(Encoder, file, spaced, 400_000), end_id.to_bytes(4, "little")
        held: list[bytes] = []
        docs: list = []
        size = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, size, shard
            ids = np.frombuffer(b"".join(held), "<u4")
            starts = np.r_[0, np.cumsum([len(h) // 4 for h in held])]
            data = shard_bytes(part, shard, docs, ids, starts, **how)
            row = {"part": part, "shard": shard, "path": put_file(folder, f"shard-{part:06d}-{shard:06d}.ids", data), "n_docs": len(docs), "n_ids": size, "n_bytes": len(data)}
            held, docs, size, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), encoder.all(batch.column(1).to_pylist())):
                got += end
                held.append(got)
                docs.append(doc)
                size += len(got) // 4
                if size >= shard_ids:
                    yield flush()
        if docs:
            yield flush()
        tidy()

    rows = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(rows.mapInArrow(encoded, "part int, shard int, path string, n_docs long, n_ids long, n_bytes long"), "shards")


def read_documents(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (binary) of each document, decoded from the files in folder.

    start counts the ids of all documents before it: those of earlier shards, summed over the few rows of `shards`, and
    those before it in its own.
    """

    def decoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                s = Shard(data)
                ids = s.all_ids().astype("<u4").tobytes()
                spans = [ids[4 * a : 4 * b] for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())]
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.part] * n, pa.int32()), pa.array([s.shard] * n, pa.int32()), pa.array([None if d == NULL_ID else d for d in s.doc_ids.tolist()], pa.int64()), pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(spans, pa.binary())],
                    ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"],
                )

    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("content")
    rows = files.mapInArrow(decoded, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, file: str, end_id: int, spaced: bool, **how) -> DataFrame:
    """Writes docs as shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    shards = write_shards(docs, folder, file, end_id, spaced, **how)
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    return read_documents(spark, folder, shards)
