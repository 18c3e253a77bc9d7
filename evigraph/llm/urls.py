"""URL filters by a sorted array of 64-bit digests that tasks map into memory.

A rule is a host and the beginning of a path, written as one string. Building sorts the rules' xxhash64 digests in ranges and writes each
range as one Arrow file below the shared folder: ``key``, ascending, and beside it the whole ``name`` and what it says. Looking a URL up
takes its host and the domains above it, then, for those that rules speak of, the beginnings of its path as long as these rules' paths. All
names of a batch are hashed and found by one binary search for the batch, and a found digest counts only if the stored name is the
same string, so a collision changes nothing. Files are mapped, not read, where the shared folder is a mounted one: tasks on a machine
share the pages that searches touch, and nothing passes through the driver or is broadcast but the files' names and first digests.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, new_path, slices, widened

SEED = 42
#: Names in one file.
FILE_NAMES = 4_000_000


# --- URLs ------------------------------------------------------------------------------------------------------------------------


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; and then up to ``?``, ``#`` or the end.
    Both are empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return F.translate(part("^([^/?#]*)"), string.ascii_uppercase, string.ascii_lowercase), part("^[^/?#]*([^?#]*)")


# --- arrays ------------------------------------------------------------------------------------------------------------------------


def digests(names: list[str], bits: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in names), np.uint64, len(names)) >> np.uint64(64 - bits)


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; ``file:/…`` and plain paths are local or mounted ones."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def opened(uri: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(keys, names, what they say) of a file: views of the mapped file, or of its bytes where it is in a store that can't be mapped."""
    where, path = place_of(uri)
    source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else pa.BufferReader(where.open_input_file(path).read_buffer())
    batch = pa.ipc.open_file(source).get_batch(0)
    return batch.column(0).to_numpy(), batch.column(1), batch.column(2)


#: The files of a list that a worker has opened so far.
_opened = kept_by_worker(lambda uris: {})


@dataclass(frozen=True)
class Names:
    """Sorted files of names: URIs and first keys, ascending, and the bits of a digest."""

    files: tuple[str, ...]
    firsts: tuple[int, ...]
    bits: int

    def find(self, names: list[str]) -> tuple[np.ndarray, list]:
        """Of the names that are stored: their places in ``names``, ascending, and what is stored with each."""
        if not self.files or not names:
            return np.empty(0, np.int64), []
        keys, texts = digests(names, self.bits), pa.array(names, pa.string())
        # equal digests never lie in two files
        part = np.maximum(np.searchsorted(np.array(self.firsts, np.uint64), keys, "right") - 1, 0)
        places, said = [], []
        for k in np.unique(part).tolist():
            open_files = _opened(self.files)
            stored, whole, says = open_files.get(k) or open_files.setdefault(k, opened(self.files[k]))
            at = np.flatnonzero(part == k)
            spot = np.searchsorted(stored, keys[at])
            while True:
                inside = spot < len(stored)
                at, spot = at[inside], spot[inside]
                same = stored[spot] == keys[at]
                at, spot = at[same], spot[same]
                if not len(at):
                    break
                hit = pc.equal(whole.take(pa.array(spot)), texts.take(pa.array(at))).to_numpy(zero_copy_only=False)
                places.append(at[hit])
                said += says.take(pa.array(spot[hit])).to_pylist()
                # a stored name that only shares the digest: look at the next one
                at, spot = at[~hit], spot[~hit] + 1
        places = np.concatenate([np.empty(0, np.int64), *places])
        order = np.argsort(places, kind="stable")
        return places[order], [said[i] for i in order.tolist()]


def sorted_names(named: DataFrame, bits: int = 64, file_names: int = FILE_NAMES) -> Names:
    """Files of distinct ``named`` (name, says) below the shared folder. ``bits`` below 64 are for tests of collisions.

    A task writes the range of digests it gets under a name of its own, so a task that runs again leaves a file that nobody reads.
    """
    spark = named.sparkSession
    folder = new_path(spark, "names")
    keyed = named.withColumn("key", F.shiftrightunsigned(F.xxhash64("name"), 64 - bits))
    # Spark's numbers are signed: with the highest bit turned they ascend like unsigned ones
    keyed = keyed.withColumn("_order", F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).persist()
    ranges = -(-keyed.count() // file_names)
    schema = pa.schema([("key", pa.uint64()), ("name", pa.string()), ("says", named.select("says").limit(0).toArrow().schema.field(0).type)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        rows = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
        key = pa.array(rows.column("key").to_numpy().view(np.uint64))
        where, path = place_of(f"{folder}/{uuid.uuid4().hex}.arrow")
        where.create_dir(path.rpartition("/")[0], recursive=True)
        with where.open_output_stream(path) as out, pa.ipc.new_file(out, schema) as file:
            file.write_batch(pa.RecordBatch.from_arrays([key, rows.column("name").cast(pa.string()), rows.column("says").cast(schema.field(2).type)], schema=schema))
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{path.rpartition('/')[2]}"], "first": rows.column("key").slice(0, 1)})

    laid = keyed.repartitionByRange(max(1, ranges), "_order").sortWithinPartitions("_order").select("key", "name", "says")
    # a row for each file
    made = sorted((r.first % (1 << 64), r.file) for r in laid.mapInArrow(write, "file string, first bigint").collect())
    keyed.unpersist()
    return Names(tuple(f for _, f in made), tuple(k for k, _ in made), bits)


@dataclass(frozen=True)
class Rules:
    """hosts: the lengths of the paths in each host's rules; rules: host and path as one string, and what it says; labels: dots in a host, and one."""

    hosts: Names
    rules: Names
    labels: int


def rule_arrays(rules: DataFrame, *, bits: int = 64, file_names: int = FILE_NAMES) -> Rules:
    """Arrays of ``rules`` (host, path, verdict), which may be of any number. Hosts are lower-cased like those of URLs.

    A rule with a null column, or with a path that is neither empty nor begins with ``/``, fits nothing and is left out; of equal rules
    with different verdicts ``block`` counts.
    """
    rules = rules.select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), "path", "verdict").where("host is not null and verdict is not null and (path = '' or path like '/%')")
    names = rules.groupBy(F.concat("host", "path").alias("name")).agg(F.max("verdict").alias("says"))
    hosts = rules.groupBy(F.col("host").alias("name")).agg(F.array_sort(F.collect_set(F.length("path"))).alias("says"))
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n or 0
    return Rules(sorted_names(hosts, bits, file_names), sorted_names(names, bits, file_names), labels)


def domains(host: str, labels: int) -> Iterator[str]:
    """A host and the domains above it, of at most ``labels`` labels each, the shortest first."""
    at = len(host)
    for _ in range(labels):
        at = host.rfind(".", 0, at) if at > 0 else -1
        yield host[at + 1 :]
        if at < 0:
            break


def judged(hosts: pa.Array, paths: pa.Array, arrays: Rules) -> tuple[list, list]:
    """(rule, what it says) for each URL, null where no rule fits."""
    encoded = hosts.dictionary_encode()
    above = [(i, d) for i, h in enumerate(encoded.dictionary.to_pylist()) for d in domains(h, arrays.labels)]
    places, lengths = arrays.hosts.find([d for _, d in above])
    known: dict[int, list[tuple[str, list[int]]]] = {}
    for p, n in zip(places.tolist(), lengths):
        known.setdefault(above[p][0], []).append((above[p][1], n))
    rows, names = [], []
    for row, (i, path) in enumerate(zip(encoded.indices.to_pylist(), paths.to_pylist())):
        for domain, sizes in known.get(i, ()):
            for n in sizes:
                if n > len(path):
                    break
                rows.append(row)
                names.append(domain + path[:n])
    rule, verdict = [None] * len(hosts), [None] * len(hosts)
    places, says = arrays.rules.find(names)
    for p, v in zip(places.tolist(), says):
        # shorter domains come first, so of equally long rules the one with the longer host stays
        if rule[rows[p]] is None or len(names[p]) >= len(rule[rows[p]]):
            rule[rows[p]], verdict[rows[p]] = names[p], v
    return rule, verdict


def url_filter(pages: DataFrame, rules: DataFrame | Rules, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of each URL.

    A rule fits its host and all domains below it, if the path begins with the rule's; the longest rule decides, of equally long ones that
    with the longer host. A URL that no stored rule fits is not on the list and gets ``default``, and a null ``rule``. Null URLs and those
    without ``://`` have an empty host and path. Repeated rows keep a row each; columns with the names of the new ones are replaced; an
    empty table, and an empty list, give what they hold. There is no shuffle of pages, whatever share of them one host has.
    """
    arrays = rules if isinstance(rules, Rules) else rule_arrays(rules)
    kept = pages.select("*", *(c.alias(n) for c, n in zip(host_and_path(F.col(url_col)), ("_host", "_path"))))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_path"):
            host, path = b.column("_host"), b.column("_path")
            rule, verdict = judged(host, path, arrays)
            new = [host, path, pa.array(rule, pa.string()), pc.coalesce(pa.array(verdict, pa.string()), pa.scalar(default))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=[*names, "host", "path", "rule", "verdict"])

    return kept.select(*names, "_host", "_path").mapInArrow(run, widened(pages.select(*names).schema, "host string, path string, rule string, verdict string"))
