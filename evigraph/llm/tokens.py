"""Token ids in range-coded binary blocks.

``write`` lays a corpus out in ascending id order and encodes it with a static range asymmetric numeral system: one table of
frequencies, counted over the whole corpus, is shared by all blocks. A block holds whole documents of about ``block_tokens`` ids,
which are dealt in turn to interleaved lanes, each a coder of its own that is advanced for all lanes at once. Every ``step_ids`` ids of
a lane a checkpoint has the lanes' states and word positions, so a reader can start there; two checksums cover the payload and the
ids. Blocks are rows of Parquet files and can be read, split, retried and decoded in any order.

Layout of a block row: ``shard``, ``block`` (its order), ``first`` (ids before it in the corpus), ``rows`` (one struct per document: its
key columns and number of ids), ``n``, ``lanes``, ``payload`` (little-endian 32-bit words by lane), ``checkpoints`` (per checkpoint and
lane: position in words, long, then state, unsigned long), ``payload_crc32``, ``ids_crc32``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_worker, new_path, partitions, slices, small_batches, utf8

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCALE_BITS = 20
BLOCK_TOKENS = 1 << 19
STEP_IDS = 64
LANES = 2048
LOW = np.uint64(1 << 31)
#: Words that a worker remembers (about 50 bytes each), and words that are encoded in one line.
KNOWN_WORDS, LINE_WORDS = 400_000, 1 << 15
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
MARKS = ".,"
#: White space of any kind beside a space: there, the words between spaces can't be encoded one by one.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOGETHER = f" {SPACE}|{SPACE} "


# --- tokens --------------------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts, the same as the library's own for each text.

    Pre-tokens never cross a single space between two other characters, so the words between spaces are encoded by the library once,
    in one line with others, and remembered. Texts with other white space beside a space, or with an added token of the vocabulary,
    are encoded whole. Finding the different words of a slice and laying out the ids are columnar steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.by_space = '"ByteLevel"' in self.tokenizer.to_str().partition('"pre_tokenizer"')[2][:80] and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # ids whose bytes begin with a space
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.marks = Segments.of([np.empty(0, np.uint32), *map(self.encode, MARKS)])
        self.forget()

    def forget(self) -> None:
        """Remembers only the empty word, that is the space at a text's end."""
        self.words, self.known = pa.array([""], pa.string()), Segments.of([self.encode(" ")])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, words: pa.Array) -> None:
        """Remembers the ids of new words, none of them empty, each behind a space."""
        for at in range(0, len(words), LINE_WORDS):
            line = words.slice(at, LINE_WORDS)
            ids = self.encode(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(line)], line), " ")[0].as_py())
            # no word holds a space, so it is where the ids of the next one begin
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            new = Segments(ids, cuts[:-1], np.diff(cuts)) if len(cuts) == len(line) + 1 else Segments.of([self.encode(" " + w) for w in line.to_pylist()])
            self.words, self.known = pa.concat_arrays([self.words, line]), self.known.with_more(new)

    def ids_of(self, words: pa.Array) -> Segments:
        """Ids of distinct words, each behind a space."""
        # a full stop or comma behind a letter or digit is a pre-token of its own
        marked = pc.match_substring_regex(words, "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,]$")
        mark = np.zeros(len(words), np.int64)
        for i, m in enumerate(MARKS, 1):
            mark[pc.and_(marked, pc.ends_with(words, m)).to_numpy(zero_copy_only=False)] = i
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        if len(self.words) > KNOWN_WORDS:
            self.forget()
        at = pc.index_in(stems.dictionary, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            at[new] = len(self.words) + np.arange(new.sum())
            self.learn(stems.dictionary.filter(pa.array(new)))
        known = self.known.with_more(self.marks)
        codes = np.stack((at[stems.indices.to_numpy()], len(self.words) + mark), 1).ravel()
        return known.joined(codes, 2 * np.arange(len(words)))

    def many(self, texts: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text (none null), with ``end_id`` behind them if there is one."""
        end = np.array([] if end_id is None else [end_id], np.uint32)
        whole = pc.match_substring_regex(texts, TOGETHER) if self.by_space else pa.array([True] * len(texts), pa.bool_())
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        pieces = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        first, each = pieces.offsets.to_numpy()[:-1].astype(np.int64), pieces.values.dictionary_encode()
        if not len(first):
            return []
        begins = pieces.values.take(pa.array(first)).dictionary_encode()
        codes = each.indices.to_numpy().astype(np.int64)
        codes[first] = len(each.dictionary) + begins.indices.to_numpy()
        heads = Segments.of([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(begins.dictionary.to_pylist(), add_special_tokens=False)])
        known = self.ids_of(each.dictionary).with_more(heads).with_more(Segments.of([end]))
        codes = np.insert(codes, np.append(first[1:], len(codes)), len(known.sizes) - 1)
        laid = known.joined(codes, first + np.arange(len(first)))
        found = [laid.ids[a : a + n] for a, n in zip(laid.starts.tolist(), laid.sizes.tolist())]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            found[i] = np.concatenate((self.encode(texts[i].as_py()), end))
        return found


@dataclass
class Segments:
    """Runs of ids: where each begins in ``ids`` and how many it has."""

    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Segments:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return cls(np.concatenate([np.empty(0, np.uint32), *parts]), np.cumsum(sizes) - sizes, sizes)

    def with_more(self, other: Segments) -> Segments:
        return Segments(np.concatenate((self.ids, other.ids)), np.concatenate((self.starts, len(self.ids) + other.starts)), np.concatenate((self.sizes, other.sizes)))

    def joined(self, codes: np.ndarray, firsts: np.ndarray) -> Segments:
        """The runs named by ``codes`` one behind the other; a new run begins at each of the ascending places ``firsts`` in ``codes``."""
        n = self.sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[codes] - (ends - n), n)
        at += np.arange(len(at))
        starts = (ends - n)[firsts]
        return Segments(self.ids[at], starts, np.diff(np.append(starts, len(at))))


@kept_by_worker
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- coder ---------------------------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, at least 1 for each id that occurs."""
    total, scale = counts.sum(), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    out = np.where(counts > 0, np.maximum(1, counts * (scale / total)).astype(np.int64), 0)
    left = scale - int(out.sum())
    for i in np.argsort(-out, kind="stable"):
        change = max(left, -int(out[i] // 2)) if left < 0 else left
        out[i] += change
        left -= change
        if not left:
            return out.astype(np.uint32)
    raise ValueError("more ids than the scale has room for")


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.freq, self.bits = freq.astype(np.uint64), np.uint64(bits)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @staticmethod
    def lanes(n: int) -> int:
        lanes = 1
        while lanes < LANES and lanes * STEP_IDS < n:
            lanes *= 2
        return lanes

    def encode(self, ids: np.ndarray) -> tuple[int, bytes, bytes]:
        """(lanes, payload, checkpoints). Coding runs from the last id to the first; a reader goes forward."""
        n, lanes = len(ids), self.lanes(len(ids))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words, used = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), bool)
        marks: list[tuple[int, np.ndarray]] = []
        thirty_two, top = np.uint64(32), np.uint64(63) - self.bits
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            x, f = state[: len(s)], self.freq[s]
            spill = (x >> top) >= f
            words[t, : len(s)][spill] = (x[spill] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            used[t, : len(s)] = spill
            x = np.where(spill, x >> thirty_two, x)
            q = x // f
            state[: len(s)] = (q << self.bits) + (x - q * f) + self.start[s]
            if t % STEP_IDS == 0:
                marks.append((t, state.copy()))
        per_lane = used.sum(0)
        begin = np.concatenate(([0], np.cumsum(per_lane)[:-1])).astype(np.int64)
        payload = words.T[used.T].astype("<u4").tobytes()
        points = b"".join((begin + used[:t].sum(0)).astype("<i8").tobytes() + x.astype("<u8").tobytes() for t, x in reversed(marks))
        return lanes, payload, points

    def decode(self, n: int, lanes: int, payload: bytes, points: bytes, part: int = 0, parts: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``part`` on (all of them by default, or those of ``parts`` checkpoints)."""
        words, steps = np.concatenate((np.frombuffer(payload, "<u4"), [0])).astype(np.uint64), -(-n // lanes)
        if part * STEP_IDS >= steps:
            return np.empty(0, np.uint32)
        size = 8 * lanes
        at = np.frombuffer(points, "<i8", lanes, 2 * part * size).copy()
        state = np.frombuffer(points, "<u8", lanes, (2 * part + 1) * size).copy()
        last = steps if parts is None else min(steps, (part + parts) * STEP_IDS)
        mask, thirty_two, out = np.uint64((1 << int(self.bits)) - 1), np.uint64(32), []
        for t in range(part * STEP_IDS, last):
            k = min(lanes, n - t * lanes)
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot]
            x = self.freq[s] * (x >> self.bits) + slot - self.start[s]
            low = x < LOW
            state[:k] = np.where(low, (x << thirty_two) | words[np.where(low, at[:k], -1)], x)
            at[:k] += low
            out.append(s)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


# --- files ---------------------------------------------------------------------------------------------------------------------

BLOCK = "n long, lanes int, payload binary, checkpoints binary, payload_crc32 long, ids_crc32 long"


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes blocks below ``path``/blocks and the table below ``path``/table.

    Rows are in ascending order of the id (nulls first), then of the text; a null text is empty. Other columns aren't written.
    An empty table gives empty folders.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # ranges by the id and the beginning of the text, which sorts like the text: their bounds are sampled to the driver
    ordered = rows.repartitionByRange(partitions(spark), "id", F.substring("text", 1, 16)).sortWithinPartitions("id", "text")
    span = count = pa.struct([("id", pa.int64()), ("n", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, parts, n, before = [], [], 0, 0

        def flush():
            sizes = pa.array([len(p) for p in parts], pa.int64())
            rows = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pa.StructArray.from_arrays([pa.array(held, pa.int64()), sizes], fields=list(span)))
            ids = np.concatenate(parts)
            counts = np.bincount(ids)
            some = np.flatnonzero(counts)
            counts = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.StructArray.from_arrays([pa.array(some), pa.array(counts[some])], fields=list(count)))
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), rows, pa.array([before], pa.int64()), pa.array([n], pa.int64()), counts, pa.array([ids.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "rows", "first", "n", "counts", "ids"])

        for b in slices(batches, limit=SLICE):
            for i, ids in zip(b.column("id").to_pylist(), encode.many(pc.fill_null(b.column("text"), ""), end_id)):
                if held and n + len(ids) > block_tokens:
                    yield flush()
                    held, parts, n, before, block = [], [], 0, before + n, block + 1
                held.append(i)
                parts.append(ids)
                n += len(ids)
        if held:
            yield flush()

    staged = ordered.mapInArrow(blocks, "shard int, block int, rows array<struct<id:bigint,n:bigint>>, first long, n long, counts array<struct<id:bigint,n:bigint>>, ids binary")
    staged.write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/staged")

    # one row for each id of the vocabulary at most
    table = staged.select(F.explode("counts").alias("c")).groupBy(F.col("c.id").alias("id")).agg(F.sum("c.n").alias("n")).orderBy("id")
    table.coalesce(1).write.parquet(f"{path}/table")
    freq = spark.sparkContext.broadcast(read_table(spark, path))
    # a total for each shard: as many as there are partitions
    totals, before, at = staged.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect(), {}, 0
    for r in totals:
        before[r.shard], at = at, at + r.n

    def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies(freq.value))
        for b in slices(batches, "ids"):
            out = []
            for x in utf8(b.column("ids")):
                lanes, payload, points = coder.encode(np.frombuffer(x, "<u4"))
                out.append((lanes, payload, points, zlib.crc32(payload), zlib.crc32(x)))
            first = pa.array([before[s] + i for s, i in zip(b.column("shard").to_pylist(), b.column("first").to_pylist())], pa.int64())
            columns = [b.column("shard"), b.column("block"), b.column("rows"), first, b.column("n")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())))], names=["shard", "block", "rows", "first", "n", "lanes", "payload", "checkpoints", "payload_crc32", "ids_crc32"])

    coded = staged.drop("counts").mapInArrow(encode_blocks, "shard int, block int, rows array<struct<id:bigint,n:bigint>>, first long, " + BLOCK)
    coded.write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """Counts by id; the table has a row for each id of the vocabulary at most."""
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document, decoded from the files; a block that fails a checksum is an error."""
    freq = spark.sparkContext.broadcast(read_table(spark, path))
    kinds = "shard int, block int, rows array<struct<id:bigint,n:bigint>>, first long, " + BLOCK
    blocks = spark.read.schema(kinds).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies(freq.value))
        for b in slices(batches, "payload"):
            for r in b.to_pylist():
                if zlib.crc32(r["payload"]) != r["payload_crc32"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']}: the payload is damaged")
                ids = coder.decode(r["n"], r["lanes"], r["payload"], r["checkpoints"]).astype("<u4").tobytes()
                if zlib.crc32(ids) != r["ids_crc32"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']}: the ids are damaged")
                n = np.array([x["n"] for x in r["rows"]], np.int64)
                ends = np.cumsum(n)
                texts = [ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x in r["rows"]], pa.int64()), pa.array(r["first"] + ends - n), pa.array(n), pa.array(texts, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` (to a fresh folder below the shared one by default) and returns what ``read`` finds in the files."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, path, **options)
    return read(spark, path)


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
