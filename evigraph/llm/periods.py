"""Periodic runs of words: maximal stretches in which the words repeat at a fixed distance.

Two suffix trees of a document's words, of the words in order and in reversed order, are built by Ukkonen's algorithm; an Euler tour
of each with minima of blocks answers the longest common extension of any two positions in constant time. Each position's longest
Lyndon words, for an order of the words and for its reverse, are the candidate roots of a run. Every run has such a root, so extending
all candidates to both sides by the trees finds every run with its smallest period.

Before that, columnar steps over a slice of documents leave out words that no run can hold: a run as long as asked for holds each of
its sequences of ``gram`` words at least twice, so a word outside all sequences that are repeated within its stretch ends the stretch.
This takes nothing from a run, adds nothing to the result, and lets the trees grow with the repeated words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, slices, small_batches, widened

#: Places of an Euler tour whose minima are kept together.
BLOCK = 16
#: Passes of ``stretches``.
PASSES = 12
FACTOR = np.uint64(0x9E3779B97F4A7C15)


# --- trees ---------------------------------------------------------------------------------------------------------------------


def suffix_tree(s: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last symbol occurs once: the child behind each (node * size + symbol), and the nodes' labels
    ``s[first:last]``. Node 0 is the root; leaves end at ``len(s)`` and are made in the order of their suffixes."""
    n, size = len(s), max(s) + 1
    first, last, link, go = [0], [0], [0], {}
    node = edge = length = pending = 0
    for i, c in enumerate(s):
        pending += 1
        unlinked = 0
        while pending:
            if not length:
                edge = i
            key = node * size + s[edge]
            child = go.get(key)
            if child is None:
                go[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                begin = first[child]
                long = last[child] - begin
                if length >= long:
                    node = child
                    edge += long
                    length -= long
                    continue
                if s[begin + length] == c:
                    if unlinked:
                        link[unlinked] = node
                    length += 1
                    break
                inner = len(first)
                cut = begin + length
                first += (begin, i)
                last += (cut, n)
                link += (0, 0)
                go[key] = inner
                go[inner * size + c] = inner + 1
                go[inner * size + s[cut]] = child
                first[child] = cut
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return go, first, last


class Extensions:
    """Longest common extensions of positions of a sequence, by the Euler tour of its suffix tree.

    ``rank``: the place of each position's suffix in the order of all, the symbols compared as numbers. The last symbol must occur once."""

    def __init__(self, s: list[int]):
        n, size = len(s), max(s) + 1
        go, first, last = suffix_tree(s)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        nodes = np.fromiter(go.values(), np.int64, len(go))
        del go
        order = np.argsort(keys)  # by node, then by symbol
        kids = nodes[order].tolist()
        begins = np.searchsorted(keys[order] // size, np.arange(len(first) + 1)).tolist()
        leaf = np.array(last) == n
        leaf[0] = False
        suffix = np.cumsum(leaf) - 1
        lengths = (np.array(last) - np.array(first)).tolist()
        inner = (~leaf).tolist()
        del keys, nodes, order
        # the tour: a node's depth in symbols before, between and after its children
        tour, met, at = [], [], [0] * len(first)
        next_kid, path, depth = begins[:-1], [0], [0]
        while path:
            node = path[-1]
            k = next_kid[node]
            tour.append(depth[-1])
            if k < begins[node + 1]:
                next_kid[node] = k + 1
                child = kids[k]
                deep = depth[-1] + lengths[child]
                if inner[child]:
                    path.append(child)
                    depth.append(deep)
                else:
                    at[child] = len(tour)
                    met.append(child)
                    tour.append(deep)
            else:
                path.pop()
                depth.pop()
        self.place = np.array(at, np.int64)[leaf]
        self.rank = np.empty(n, np.int64)
        self.rank[suffix[np.array(met)]] = np.arange(n)
        self.minima(np.array(tour, np.int32))

    def minima(self, tour: np.ndarray) -> None:
        full = np.full(-(-len(tour) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        full[: len(tour)] = tour
        blocks = full.reshape(-1, BLOCK)
        self.tour = full
        self.head = np.minimum.accumulate(blocks, 1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while (step := 1 << (len(self.levels) - 1)) < len(self.levels[-1]):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` on and from ``j`` on are the same, for different positions."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low = np.minimum(self.tail[a], self.head[b])
        x, y = a // BLOCK, b // BLOCK
        same = x == y
        if same.any():
            p, q = a[same], b[same]
            least = self.tour[p]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.tour[np.minimum(p + k, q)])
            low[same] = least
        count = y - x - 1
        level = np.frexp(np.maximum(count, 1))[1] - 1
        for k in np.unique(level[count > 0]).tolist():
            m = (level == k) & (count > 0)
            t = self.levels[k]
            low[m] = np.minimum(low[m], np.minimum(t[x[m] + 1], t[y[m] - (1 << k)]))
        return low


def next_smaller(rank: list[int]) -> list[int]:
    """The next position with a smaller rank, or -1."""
    found, open_ = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            found[open_.pop()] = i
        open_.append(i)
    return found


def runs_of(words: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``words`` (numbers from 1 on) of at least ``least`` words and ``exponent`` (2 or
    more) periods, by start and then period."""
    n = len(words)
    if n < max(least, 2):
        return np.empty((0, 3), np.int64)
    s = words.tolist()
    ahead, back = Extensions([*s, 0]), Extensions([*s[::-1], 0])
    up = ahead.rank.tolist()
    roots = np.concatenate([np.stack((np.arange(n + 1), next_smaller(x)), 1) for x in (up, [-r for r in up])])
    i, j = roots[(roots[:, 1] > 0) & (roots[:, 0] < n)].T
    start, end, period = i - back(n - i, n - j), j + ahead(i, j), j - i
    found = np.stack((start, end - start, period), 1)
    found = found[(end - start) >= np.maximum(least, exponent * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


# --- slices of documents ---------------------------------------------------------------------------------------------------------


def gram_size(exponent: int, least: int) -> int:
    """The largest sequence of words that a run holds twice wherever it begins: a run of n words and period q does if n > 2q + gram - 2."""
    return max(1, min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2)))


def stretches(ids: np.ndarray, piece: np.ndarray, gram: int, least: int) -> np.ndarray:
    """Whether each word may be part of a run; ``piece`` numbers the texts in ascending order.

    Words outside all sequences that repeat within their stretch go, and the stretch is cut there, until nothing changes or ``PASSES``
    passes are over: what is left then is for the trees, which find the same runs in more words."""
    keep = np.ones(len(ids), bool)
    for _ in range(PASSES):
        at = np.flatnonzero(keep)
        if not len(at):
            break
        own = ids[at].astype(np.uint64) + np.uint64(1)
        # a stretch ends where words were left out or the text changes
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(piece[at]) != 0)
        stretch = np.cumsum(new)
        m = len(at) - gram + 1
        cover = np.zeros(len(at) + 1, np.int64)
        if m > 0:
            key = stretch[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for k in range(gram):
                key = (key ^ own[k : k + m]) * FACTOR
                key ^= key >> np.uint64(29)
            # two equal keys of different words would only leave more to the trees
            whole = np.flatnonzero(stretch[:m] == stretch[gram - 1 :])
            again = whole[pd.Series(key[whole]).duplicated(keep=False).to_numpy()]
            np.add.at(cover, again, 1)
            np.add.at(cover, again + gram, -1)
        good = np.cumsum(cover)[:-1] > 0
        # stretches that are too short go
        starts = np.flatnonzero(np.diff(np.where(good, stretch, 0), prepend=-1))
        sizes = np.diff(np.append(starts, len(at)))
        good &= np.repeat(sizes >= least, sizes)
        if good.all():
            break
        keep[at[~good]] = False
    return keep


def runs_of_texts(ids: np.ndarray, piece: np.ndarray, exponent: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, runs with their starts counted over all words) for texts that may have runs."""
    keep = np.flatnonzero(stretches(ids, piece, gram_size(exponent, least), least))
    if not len(keep):
        return
    bounds = np.append(np.flatnonzero(np.diff(piece[keep], prepend=-1)), len(keep))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        at = keep[a:b]
        # words left out between two stretches become one mark that occurs nowhere else
        _, words = np.unique(ids[at], return_inverse=True)
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        s = np.insert(words + 1, gaps, words.max() + 2 + np.arange(len(gaps)))
        found = runs_of(s, exponent, least)
        found[:, 0] = np.insert(at, gaps, -1)[found[:, 0]]
        yield int(piece[at[0]]), found


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and the text of each; a null text has none."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words, text = split.flatten(), np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    some = pc.not_equal(words, "")
    return words.filter(some), text[some.to_numpy(zero_copy_only=False)]


def periodic_runs(docs: DataFrame, *, text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period in words, by start and then period) and ``collapsed``, the words
    outside the repeats joined by one space.

    A word is ``[^\\x20\\x09-\\x0D]+``. A run is a maximal stretch with a smallest period, of at least ``least`` words and ``exponent``
    periods (2 or more); its words after the first period are repeats. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Repeated rows keep a row each; columns with the names of the new ones are replaced; an empty table gives an empty one.
    A text is the work of one task and needs about 1 kB for each word of its repeated stretches.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    new = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    kept = docs.drop("n_words", "runs", "collapsed")
    names, key = kept.columns, "_text"
    while key in names:
        key += "_"
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in slices(batches, key):
            words, text = words_of(b.column(key))
            sizes = np.bincount(text, minlength=b.num_rows)
            first = np.cumsum(sizes) - sizes
            ids = words.dictionary_encode().indices.to_numpy()
            runs: list[list[dict]] = [[] for _ in range(b.num_rows)]
            repeated = np.zeros(len(words) + 1, np.int64)
            for i, found in runs_of_texts(ids, text, exponent, least):
                np.add.at(repeated, found[:, 0] + found[:, 2], 1)
                np.add.at(repeated, found[:, 0] + found[:, 1], -1)
                runs[i] = [{"start": s, "length": n, "period": p} for s, n, p in (found - (first[i], 0, 0)).tolist()]
            once = np.cumsum(repeated)[:-1] == 0
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text[once], minlength=b.num_rows))))
            collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.filter(pa.array(once))), pa.scalar(" ", pa.large_string()))
            columns = [*(b.column(i) for i in range(len(names))), pa.array(sizes, pa.int64()), pa.array(runs, span), collapsed.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "runs", "collapsed"])

    return kept.withColumn(key, F.col(text_col).cast("string")).mapInArrow(run, widened(kept.schema, new))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in each tenth document: with h the crc32 of the id's decimals and g = h div 10, the n words of
    a text with h % 10 = 0 go on from word a = g % n in a period of 1 + (n - a) div (3 + g % 8). Other texts and null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("_words"))
    g, n = F.floor(F.col("_h") / 10), F.size("_words").cast("long")
    some = some.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1 - F.col("_a")), lambda i: F.element_at("_words", (F.col("_a") + i % F.col("_p") + 1).cast("int")))
    repeated = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return some.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period), and checksums of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.n")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(-1000 * F.col("_best.n") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
