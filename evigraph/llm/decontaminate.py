"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words. The shingles of a window are ordered by rarity in the corpus, and as a
match must contain all of them, the rarest one is the prefix that has to be joined: a document position holding it is a candidate
for exactly the windows that chose it, at a known offset (the positional bound), if the document is long enough on both sides (the
length bound). Candidates are verified word by word, so the result is exact.

The benchmark is a stated query set that is taken in blocks of at most ``block_windows`` windows; a block is what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, widened, written

WINDOW = 10
SHINGLE = 3
#: Byte by byte: A-Z in lower case, other ASCII but digits and letters as white space.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
BLOCK_WINDOWS = 1 << 17


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Block:
    """Windows of some items: for each window length its words as numbers, the items it belongs to and its shingles."""

    items: list  # item ids
    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]  # length -> (n, length)
    owners: dict[int, list[np.ndarray]]  # length -> per window, indexes of items
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted codes, their windows, their offsets

    def number(self, text: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in text), np.int64, len(text))

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for the shingle at each position; 0 if a word of it is in no item."""
        n, base = len(ids) - size + 1, len(self.vocabulary) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = ids[:n].copy(), ids[:n] > 0
        for k in range(1, size):
            code = code * base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, code, 0)


def _size(length: int) -> int:
    return min(SHINGLE, length)


def block_of(rows: list[tuple]) -> Block:
    """rows: (item_id, text bytes); items without words take no part."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    items: list = []
    for item, text in rows:
        w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text)]
        if w:
            items.append(item)
            for i in range(max(1, len(w) - WINDOW + 1)):
                found.setdefault(tuple(w[i : i + WINDOW]), set()).add(len(items) - 1)
    windows = {n: np.array([w for w in found if len(w) == n], np.int64) for n in {len(w) for w in found}}
    owners = {n: [np.array(sorted(found[tuple(w)])) for w in a.tolist()] for n, a in windows.items()}
    return Block(items, vocabulary, windows, owners, {})


def _shingles(block: Block) -> dict[int, np.ndarray]:
    """By shingle size, all codes of the block's windows."""
    out: dict[int, list[np.ndarray]] = {}
    for n, w in block.windows.items():
        k = _size(n)
        out.setdefault(k, []).append(np.unique(np.concatenate([block.codes(row, k) for row in w])))
    return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def frequencies(texts: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all of ``texts``; at most one row for each of them returns."""
    wanted = _shingles(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
        for b in slices(batches):
            for text in utf8(b.column("text")):
                ids = block.number(words(text))
                for k, v in wanted.items():
                    c = block.codes(ids, k)
                    c = c[c > 0]
                    at = np.minimum(np.searchsorted(v, c), len(v) - 1)
                    counts[k] += np.bincount(at[v[at] == c], minlength=len(v))
        for k, v in wanted.items():
            some = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(v[some]), pa.array(counts[k][some])], names=["size", "code", "n"])

    rows = texts.select("text").mapInArrow(run, "size int, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n")).collect()
    return {(r.size, r.code): r.n for r in rows}


def choose_prefixes(block: Block, counts: dict[tuple[int, int], int]) -> None:
    """Each window's rarest shingle (the first of equals) becomes its prefix."""
    for n, w in block.windows.items():
        k = _size(n)
        chosen = []
        for i, row in enumerate(w):
            codes = block.codes(row, k).tolist()
            at = min(range(len(codes)), key=lambda j: (counts.get((k, codes[j]), 0), j))
            chosen.append((codes[at], i, at))
        codes, which, offset = (np.array(x, np.int64) for x in zip(*sorted(chosen)))
        block.prefix[n] = codes, which, offset


def match(block: Block, text: bytes) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, positions hit and indexes of the items with occurring windows."""
    w = words(text)
    ids = block.number(w)
    hit, items, by_size = np.zeros(len(w) + 1, np.int64), set(), {}
    for n, (codes, which, offset) in block.prefix.items():
        k = _size(n)
        c = by_size[k] if k in by_size else by_size.setdefault(k, block.codes(ids, k))
        first, last = np.searchsorted(codes, c, "left"), np.searchsorted(codes, c, "right")
        at = np.flatnonzero(last > first)
        if not len(at):
            continue
        many = (last - first)[at]
        at_all = np.repeat(at, many)
        chosen = np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, window = at_all - offset[chosen], which[chosen]
        fits = (start >= 0) & (start + n <= len(ids))
        start, window = start[fits], window[fits]
        same = np.ones(len(start), bool)
        for j in range(n):
            same &= ids[start + j] == block.windows[n][window, j]
        np.add.at(hit, start[same], 1)
        np.add.at(hit, start[same] + n, -1)
        for x in np.unique(window[same]).tolist():
            items.update(block.owners[n][x].tolist())
    return len(w), np.flatnonzero(np.cumsum(hit)[: len(w)] > 0), items


def blocks_of(benchmark: DataFrame, *, item_col: str, text_col: str, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_windows`` windows (or one item), read as a stream; one block at least."""
    held, n = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        more = max(1, len(words(bytes(r.text))) - WINDOW + 1)
        if held and n + more > block_windows:
            yield block_of(held)
            held, n = [], 0
        held.append((r.item, bytes(r.text)))
        n += more
    yield block_of(held)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, hits (ascending word positions inside occurring windows) and items (sorted ids, as strings) for each row.

    A null text has no words; an item without words, or a null item, occurs nowhere; repeated items count by distinct id, and a null
    id counts as none. An empty benchmark hits nothing. Columns of the same names in ``docs`` are replaced. All words of a text are looked
    at, however many, in the task that has the text; equal rows get equal results; items that share a window are all named.
    """
    found = docs.drop("n_words", "hits", "items")
    names, key = found.columns, "_text"
    while key in names:
        key += "_"
    schema = widened(found.schema, "n_words long, hits array<int>, items array<string>")
    texts = found.select(F.col(text_col).cast("string").alias("text"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("hits", "array<int>"), ("items", "array<string>"))]
    now = found.select("*", *none)
    for k, block in enumerate(blocks_of(benchmark, item_col=item_col, text_col=item_text, block_windows=block_windows)):
        choose_prefixes(block, frequencies(texts, block))
        now = (written(now, "hits") if k else now).withColumn(key, F.col(text_col).cast("string")).mapInArrow(_pass(block, names, key), schema)
    return now


def _pass(block: Block, names: list[str], key: str):
    """Adds what ``block`` hits to the result columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, key):
            n, hits, items = [], [], []
            for text, had, ids in zip(utf8(b.column(key)), b.column("hits").to_pylist(), b.column("items").to_pylist()):
                size, at, got = match(block, text)
                n.append(size)
                hits.append(np.union1d(at, had or []).astype(np.int32))
                items.append(sorted({*(ids or []), *(block.items[i] for i in got if block.items[i] is not None)}))
            columns = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hits", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    return contamination(docs, benchmark, **names).where(F.size("hits") == 0).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the checksum of each row of ``contamination``."""
    return found.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


__all__ = ["contamination", "decontaminate", "digest"]
