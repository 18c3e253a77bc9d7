"""Exact removal of byte strings that repeat across a corpus, from sorted names of sampled suffixes.

Of all suffixes only a sample is named and sorted. The sample is a string synchronising set, the content-defined successor of a
difference cover, with the same guarantee: two equal strings of ``length`` bytes hold a sampled position at the same offset, at most
``REACH - 1`` in. Names stand for the next ``length - REACH + 1`` bytes, which a string must share to be equal. Sampled suffixes whose
name occurs twice are brought together with the bytes around them, and there the remaining suffixes, those up to ``REACH - 1`` bytes
before, are merged: at each distance, suffixes with equal prefixes of ``length`` bytes are neighbours and thus repeat.

Rows travel as blocks of packed arrays, one per slice of texts and bucket of names. What repeats within a slice is settled there and
is sent once, so neither a common passage nor a group of copies gathers in one task; equal texts count as one, by their key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, slices, utf8, written

LENGTH = 200
REACH = 64
GRAM = 16
KEY = 10
BUCKET_BYTES = 8 << 20
#: Bytes of text whose names are sent together.
NAMED_BYTES = 16 << 20
#: Sampled positions that are merged with their surroundings at once.
ROWS = 1 << 16
CHUNK = 4096

_rng = np.random.default_rng(17)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n + 1, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefixes(x: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any window follows; the last axis is the text."""
    up, _ = powers(x.shape[-1])
    out = np.zeros((*x.shape[:-1], x.shape[-1] + 1), np.uint64)
    np.cumsum(_BYTE[x] * up[: x.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def windows(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    _, down = powers(sums.shape[-1])
    h = (sums[at + size] - sums[at]) * down[at]
    return (h ^ (h >> np.uint64(29))) * _MIX


def _spread(x: np.ndarray, n: int, best) -> np.ndarray:
    """Best of each n consecutive values, n a power of two."""
    step = 1
    while step < n:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def sampled(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions, and their names: all least hashes of ``GRAM`` bytes among ``REACH`` consecutive ones."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = prefixes(text)
    last = len(text) - length  # the last start of a string
    g = windows(sums, np.arange(last + REACH), GRAM)
    low = _spread(g, REACH, np.minimum)
    edge = np.zeros(REACH - 1, np.uint64)
    at = np.flatnonzero(_spread(np.concatenate((edge, low, edge)), REACH, np.maximum) == g)
    return at, windows(sums, at, length - REACH + 1)


def key_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:KEY]


def key_col(text):
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 2 * KEY))


def _home(key: bytes, buckets: int) -> int:
    """Where settled answers of a text go, the same on every attempt."""
    return int.from_bytes(key[:6], "little") % buckets


def pack(**arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays.values())
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + body, 1)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, out = int.from_bytes(raw[:4], "little"), {}
    at = 4 + n
    for k, kind, size in (x.split(",") for x in raw[4:at].decode().split(";")):
        out[k] = np.frombuffer(raw, kind, int(size), at)
        at += out[k].nbytes
    return out


ROW = "bucket int, key binary, data binary"
ANSWER = "home int, key binary, data binary"


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "home": pa.int32(), "key": pa.binary(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))], names=list(names))


def _answers(keys: np.ndarray, **columns: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A packed row for each run of equal keys (fixed-size byte strings)."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], {n: c[order] for n, c in columns.items()}
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(keys[a].tobytes().ljust(KEY, b"\0"), pack(**{n: c[a:b] for n, c in columns.items()})) for a, b in zip(cuts, cuts[1:])]


def _packed(keys: np.ndarray, buckets: int, **columns: np.ndarray) -> list[tuple[int, None, bytes]]:
    """Answers for many texts, a row for each home of texts."""
    heads = keys.view(np.uint8).reshape(-1, KEY)[:, :6].astype(np.uint64)
    home = ((heads << (np.arange(6, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(buckets + 1))
    rows = []
    for h in range(buckets):
        i = order[cuts[h] : cuts[h + 1]]
        if len(i):
            rows.append((h, None, pack(keys=keys[i].view(np.uint8), **{n: c[i] for n, c in columns.items()})))
    return rows


def gathered(answers: DataFrame) -> DataFrame:
    """(key, data): the answers of all buckets put together, one row for each text."""

    def gather(group: pa.Table) -> pa.Table:
        parts: dict[str, list[np.ndarray]] = {}
        for key, data in zip(group.column("key").to_pylist(), group.column("data").to_pylist()):
            p = unpack(data)
            p["keys"] = p["keys"].view(f"S{KEY}") if key is None else np.full(len(p["at"]), key, f"S{KEY}")
            for n, c in p.items():
                parts.setdefault(n, []).append(c)
        columns = {n: np.concatenate(c) for n, c in parts.items()}
        return pa.Table.from_batches([_batch(_answers(columns.pop("keys"), **columns), ("key", "data"))])

    return answers.groupBy("home").applyInArrow(gather, "key binary, data binary")


def named(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """(key, data): the sampled positions of each text whose name occurs elsewhere in ``texts`` (text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=NAMED_BYTES):
            unique = {key_of(t): t for t in utf8(b.column("text")) if len(t) >= length}
            found = [sampled(np.frombuffer(t, np.uint8), length) for t in unique.values()]
            if not found:
                continue
            keys = np.array(list(unique), f"S{KEY}")
            doc = np.repeat(np.arange(len(found), dtype=np.uint32), [len(at) for at, _ in found])
            at, name = (np.concatenate(x) for x in zip(*found))
            at, name = at.astype(np.uint32), name >> np.uint64(16)
            _, first, inverse, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            rows = [(_home(k, buckets), k, d) for k, d in _answers(keys[doc[again]], at=at[again])]
            one = np.sort(first)
            bucket = (name[one] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            one, bucket = one[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                i = one[cuts[k] : cuts[k + 1]]
                if len(i):
                    docs, local = np.unique(doc[i], return_inverse=True)
                    data = pack(name=name[i].view(np.uint8).reshape(-1, 8)[:, :6].ravel(), at=at[i], again=again[i], doc=local.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32), keys=keys[docs].view(np.uint8))
                    rows.append((k, None, data))
            yield _batch(rows, ("bucket", "key", "data"))

    def settle(group: pa.Table) -> pa.Table:
        rows, parts = [], []
        for key, data in zip(group.column("key").to_pylist(), group.column("data").to_pylist()):
            if key is not None:
                rows.append((_home(key, buckets), key, data))
            else:
                p = unpack(data)
                name = np.zeros((len(p["at"]), 8), np.uint8)
                name[:, :6] = p["name"].reshape(-1, 6)
                parts.append((name.view(np.uint64).ravel(), p["at"], p["again"], p["keys"].view(f"S{KEY}")[p["doc"]]))
        if parts:
            name, at, again, key = (np.concatenate(x) for x in zip(*parts))
            # the same place of equal texts is one place
            order = np.lexsort((at, key, name))
            name, at, again, key = name[order], at[order], again[order], key[order]
            fresh = np.concatenate(([True], (name[1:] != name[:-1]) | (at[1:] != at[:-1]) | (key[1:] != key[:-1])))
            start = np.concatenate(([True], name[1:] != name[:-1]))
            run = np.cumsum(start) - 1
            several = np.bincount(run, fresh) + np.bincount(run, again)
            wanted = (several[run] > 1) & fresh & ~again
            rows += _packed(key[wanted], buckets, at=at[wanted])
        return pa.Table.from_batches([_batch(rows, ("home", "key", "data"))])

    return gathered(texts.mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(settle, ANSWER))


def _around(text: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per position the bytes from ``REACH - 1`` before it to ``length`` behind it, and how many are there on either side."""
    padded = np.concatenate((np.zeros(REACH - 1, np.uint8), np.frombuffer(text, np.uint8), np.zeros(length, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, REACH - 1 + length)[at]
    return rows, np.minimum(at, REACH - 1).astype(np.uint8), np.minimum(len(text) - at, length).astype(np.uint16)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes, np.ndarray]]]:
    """(key, text, named positions) in groups of at most ``ROWS`` positions."""
    held, n = [], 0
    for b in slices(batches):
        for key, text, marks in zip(b.column("key").to_pylist(), utf8(b.column("text")), b.column("marks").to_pylist()):
            at = np.unique(np.concatenate([unpack(m)["at"] for m in marks])).astype(np.int64)
            while len(at):
                held.append((key, text, at[: ROWS - n]))
                n, at = n + len(at[: ROWS - n]), at[ROWS - n :]
                if n == ROWS:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _allowed(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Bit d: a string may start d bytes before the position."""
    d = np.arange(REACH)
    fits = (d <= left[:, None]) & (length - d <= right[:, None])
    return np.packbits(fits, axis=1, bitorder="little").view(np.uint64).ravel()


def merged(work: DataFrame, buckets: int, length: int) -> DataFrame:
    """(key, data): at each named position of ``work`` (key, text, marks) a bit for every start before it that repeats."""
    width = REACH - 1 + length

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in pieces(batches):
            keys = np.concatenate([np.full(len(at), key, f"S{KEY}") for key, _, at in group])
            rows, left, right = (np.concatenate(x) for x in zip(*(_around(text, at, length) for _, text, at in group)))
            at = np.concatenate([x for _, _, x in group]).astype(np.uint32)
            name, whole = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
            for a in range(0, len(rows), CHUNK):
                sums = prefixes(rows[a : a + CHUNK])
                name[a : a + CHUNK] = _window(sums, REACH - 1, length - REACH + 1)
                whole[a : a + CHUNK] = _window(sums, 0, width)
            whole ^= (left.astype(np.uint64) * _MIX) ^ (right.astype(np.uint64) << np.uint64(40))
            _, first, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            out = [(_home(k, buckets), k, d) for k, d in _answers(keys[again], at=at[again], bits=_allowed(left[again], right[again], length))]
            one = first[np.lexsort((name[first], name[first] % np.uint64(buckets)))]
            cuts = np.searchsorted(name[one] % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))
            for k in range(buckets):
                i = one[cuts[k] : cuts[k + 1]]
                if len(i):
                    out.append((k, None, pack(rows=rows[i].ravel(), at=at[i], left=left[i], right=right[i], again=again[i], keys=keys[i].view(np.uint8))))
            yield _batch(out, ("bucket", "key", "data"))

    def settle(group: pa.Table) -> pa.Table:
        rows, parts = [], []
        for key, data in zip(group.column("key").to_pylist(), group.column("data").to_pylist()):
            if key is not None:
                rows.append((_home(key, buckets), key, data))
                continue
            p = unpack(data)
            h = np.empty((len(p["at"]), REACH), np.uint64)
            bytes_ = p["rows"].reshape(-1, width)
            for a in range(0, len(h), CHUNK):
                sums = prefixes(bytes_[a : a + CHUNK])
                name = _window(sums, REACH - 1, length - REACH + 1)
                for d in range(REACH):
                    h[a : a + CHUNK, d] = _window(sums, REACH - 1 - d, length) ^ (name * np.uint64(2 * d + 3))
            parts.append((h, p["at"], p["again"], _allowed(p["left"], p["right"], length), p["keys"].view(f"S{KEY}")))
        if parts:
            h, at, again, allowed, key = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            bits, shift = np.zeros(len(at), np.uint64), np.arange(REACH, dtype=np.uint64)
            for d in range(REACH):
                may = np.flatnonzero((allowed >> shift[d]) & np.uint64(1))
                order = may[np.argsort(h[may, d], kind="stable")]
                x = h[order, d]
                if len(x):
                    run = np.cumsum(np.concatenate(([False], x[1:] != x[:-1])))
                    several = np.bincount(run) + np.bincount(run, again[order])
                    bits[order[several[run] > 1]] |= np.uint64(1) << shift[d]
            wanted = (bits > 0) & ~again
            rows += _packed(key[wanted], buckets, at=at[wanted], bits=bits[wanted])
        return pa.Table.from_batches([_batch(rows, ("home", "key", "data"))])

    return gathered(work.select("key", "text", "marks").mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(settle, ANSWER))


def _window(sums: np.ndarray, at: int, size: int) -> np.ndarray:
    """Hash of one window of each row."""
    _, down = powers(sums.shape[-1])
    h = (sums[:, at + size] - sums[:, at]) * down[at]
    return (h ^ (h >> np.uint64(29))) * _MIX


def removed_spans(n: int, answers: list[bytes], length: int) -> np.ndarray:
    """Maximal removed runs (begin, end) of a text of n bytes."""
    change = np.zeros(n + 1, np.int64)
    for a in map(unpack, answers):
        bits = np.unpackbits(a["bits"].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, d = np.nonzero(bits)
        start = a["at"][row].astype(np.int64) - d
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
    covered = np.concatenate(([0], (np.cumsum(change)[:n] > 0).view(np.int8), [0]))
    edges = np.diff(covered)
    return np.stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)), axis=1)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, key, n_bytes, copies, spans, kept_sha256) for every row: the byte runs to be removed and the checksum of the rest.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another. Null is the
    empty text; ids may be null or repeat, and equal rows are copies of each other. ``spans`` is null where nothing, and one span
    where everything, is removed. Other columns are ignored; an empty table gives an empty one. Names and prefixes are compared by
    64-bit hashes within groups of equal names.
    """
    if length < REACH + GRAM:
        raise ValueError("the strings are too short for the sample")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", key_col(F.col("text")))
    rows = rows.withColumn("n", F.octet_length("text").cast("long"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), int(total // BUCKET_BYTES))
    copies = cut(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("rep")))
    marks = named(rows.select("text"), buckets, length).select("key", F.array("data").alias("marks"))
    side = cut(marks.join(copies, "key").select("key", "rep", "marks"))
    same = (rows["key"] == side["key"]) & rows["id"].eqNullSafe(side["rep"])
    work = written(rows.join(side, same).select(rows["key"], "text", "marks"), "repeats")
    answers = merged(work, buckets, length).select("key", F.array("data").alias("answers"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for key, text, found in zip(b.column("key").to_pylist(), utf8(b.column("text")), b.column("answers").to_pylist()):
                spans = removed_spans(len(text), found, length).tolist()
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = hashlib.sha256()
                for a, z in zip(edges[::2], edges[1::2]):
                    kept.update(text[a:z])
                out.append((key, spans, kept.hexdigest()))
            kinds = (pa.binary(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, kinds)], names=["key", "spans", "kept"])

    spans = work.select("key", "text").join(cut(answers), "key").mapInArrow(finish, "key binary, spans array<array<bigint>>, kept string").dropDuplicates(["key"])
    known = cut(copies.join(spans, "key", "left").select("key", "copies", "spans", "kept"))
    all_gone = (F.col("copies") > 1) & (F.col("n") >= length)
    narrow = rows.select("id", "key", "n", F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return narrow.join(known, "key").select(
        F.col("id").alias(id_col),
        "key",
        F.col("n").alias("n_bytes"),
        "copies",
        F.when(all_gone, F.array(F.array(F.lit(0).cast("long"), F.col("n")))).otherwise(F.col("spans")).alias("spans"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )


def digest(found: DataFrame) -> DataFrame:
    spans = F.coalesce("spans", F.array().cast("array<array<bigint>>"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), "kept_sha256")
