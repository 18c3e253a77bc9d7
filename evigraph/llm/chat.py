"""Chat formatting as a prefix tree: conversations that share their first turns are merged and shared turns are emitted once.

A turn's node is a digest of all turns up to it, so equal beginnings meet in equal nodes without comparing conversations. Distinct
conversations, ordered by their chains of nodes, are in depth-first order of the tree: each one emits only the nodes that its
predecessor in the shard lacks. Every emitted segment carries its place in the shard's output, its position ids (which run on from its
ancestors', not from its neighbours') and the intervals of the output that it attends to: those of its ancestors.

The template marks a turn as ``<|role|>``, text, ``<|end|>``. In roles and texts a backslash, ``<``, ``[`` and ``|`` are written as
``\\\\``, ``\\l``, ``\\b`` and ``\\p``, so no control string of this or a similar template can stand inside a text, and the texts come back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, partitions

ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
PLAIN = {v: k for k, v in ESCAPES.items()}
LOSS_ROLE = "assistant"
SHORT = 16  # bytes of a node


def escaped(text: str) -> str:
    return re.sub(r"[\\<\[|]", lambda m: ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: PLAIN[m[0]], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its text under the loss mask (empty for other roles)."""
    head, body = f"<|{escaped(role)}|>\n", escaped(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body) * (role == LOSS_ROLE)


def parsed(line: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = line.removeprefix("<|").partition("|>\n")
    return unescaped(role), unescaped(rest.removesuffix("<|end|>\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """One row per turn with its node, its parent, and its depth; a conversation's last turn also has its sort key.

    Turns are in ascending order of ``turn`` (nulls first), then of role and text; equal rows are turns of their own. Null roles and
    texts are empty. Rows with a null conv_id form a conversation. One conversation passes through one task as a stream.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = "conv_id long, depth int, node binary, parent binary, role string, text string, position long, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        conv, node, depth, position, key = object(), b"", 0, 0, bytearray()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TURN)], names=[f.name for f in TURN_FIELDS])

        for b in batches:
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if c != conv:
                    if last:
                        out.append((*last, bytes(key)))
                    conv, node, depth, position, key = c, b"", 0, 0, bytearray()
                elif last:
                    out.append((*last, None))
                r, t = role.encode(), text.encode()
                parent, node = node, hashlib.blake2b(b"".join((node, len(r).to_bytes(8, "little"), r, t)), digest_size=16).digest()
                key += node[:SHORT]
                last = (c, depth, node, parent, role, text, position)
                depth, position = depth + 1, position + len(segment(role, text)[0])
            if out:
                yield batch(out)
                out = []
        if last:
            yield batch([(*last, bytes(key))])

    return rows.mapInArrow(run, kind)


TURN_FIELDS = [pa.field("conv_id", pa.int64()), pa.field("depth", pa.int32()), pa.field("node", pa.binary()), pa.field("parent", pa.binary()), pa.field("role", pa.string()), pa.field("text", pa.string()), pa.field("position", pa.int64()), pa.field("key", pa.binary())]
TURN = [f.type for f in TURN_FIELDS]


def write(conversations: DataFrame, path: str) -> None:
    """Writes ``path``/segments, the shards' segments in depth-first order, and ``path``/members, each conversation's last node.

    A segment: shard, seq, node, depth, line (the formatted turn), loss_from and loss_to (in the line), position (its first position
    id), place (its first character in the shard's output), attends (array of begin and end places of its ancestors), ends (whether
    a conversation ends here). An empty table gives empty folders.
    """
    spark = conversations.sparkSession
    found = cut(turns(conversations))
    members = found.where("key is not null").select("conv_id", F.col("node").alias("leaf"), "key")
    members.select("conv_id", "leaf").write.parquet(f"{path}/members")
    n = partitions(spark)
    leaves = members.groupBy("leaf").agg(F.min("key").alias("key"))
    leaves = leaves.repartitionByRange(n, "key", "leaf").sortWithinPartitions("key", "leaf")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, seq, depth, short node, leaf): the nodes that each conversation adds to its shard, in depth-first order."""
        from pyspark import TaskContext

        shard, seq, before = TaskContext.get().partitionId(), 0, b""
        for b in batches:
            out = []
            for leaf, key in zip(b.column("leaf").to_pylist(), b.column("key").to_pylist()):
                depth = 0
                while before[depth * SHORT : (depth + 1) * SHORT] == key[depth * SHORT : (depth + 1) * SHORT] != b"":
                    depth += 1
                for d in range(depth, len(key) // SHORT):
                    out.append((shard, seq, d, key[d * SHORT : (d + 1) * SHORT], (d + 1) * SHORT == len(key)))
                    seq += 1
                before = key
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["shard", "seq", "depth", "short", "ends"])

    order = leaves.mapInArrow(emit, "shard int, seq long, depth int, short binary, ends boolean")
    nodes = found.withColumn("short", F.substring("node", 1, SHORT)).groupBy("short", "depth").agg(*(F.min(c).alias(c) for c in ("node", "role", "text", "position")))
    placed = order.join(cut(nodes), ["short", "depth"]).repartition(n, "shard").sortWithinPartitions("shard", "seq")
    kind = "shard int, seq long, node binary, depth int, line string, loss_from int, loss_to int, position long, place long, attends array<array<bigint>>, ends boolean"

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, path_ = None, 0, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["shard"] != shard:
                    shard, place, path_ = r["shard"], 0, []
                line, begin, end = segment(r["role"], r["text"])
                path_ = path_[: r["depth"]]
                attends = path_[-1] if path_ else []
                out.append((shard, r["seq"], r["node"], r["depth"], line, begin, end, r["position"], place, attends, r["ends"]))
                path_.append(_with(attends, place, place + len(line)))
                place += len(line)
            if out:
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in kind.split(", ")])

    placed.mapInArrow(lay, kind).write.parquet(f"{path}/segments")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation, from the files: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Shards are read in their order; the open path of the tree is all that a task holds.
    """
    segments = spark.read.parquet(f"{path}/segments").repartition(partitions(spark), "shard").sortWithinPartitions("shard", "seq")
    kind = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                open_ = open_[: r["depth"]]
                n, attends, whole, loss, chars, formatted = open_[-1] if open_ else (0, [], hashlib.sha256(), hashlib.sha256(), 0, 0)
                if formatted != r["position"] or attends != r["attends"]:
                    raise ValueError(f"segment {r['seq']} of shard {r['shard']} doesn't follow its ancestors")
                whole, loss = whole.copy(), loss.copy()
                role, text = parsed(r["line"])
                whole.update(f"{role}\n{text}\n".encode())
                masked = unescaped(r["line"][r["loss_from"] : r["loss_to"]])
                loss.update(masked.encode())
                here = (n + 1, _with(attends, r["place"], r["place"] + len(r["line"])), whole, loss, chars + len(masked), formatted + len(r["line"]))
                open_.append(here)
                if r["ends"]:
                    out.append((r["node"], here[0], whole.hexdigest(), here[4], loss.hexdigest(), here[5]))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in kind.split(", ")])

    digests = cut(segments.mapInArrow(run, kind))
    return spark.read.parquet(f"{path}/members").join(digests, "leaf").drop("leaf")


def _with(attends: list[list[int]], begin: int, end: int) -> list[list[int]]:
    """The intervals that a node's children attend to: its own ones and its place, joined where they meet."""
    if attends and attends[-1][1] == begin:
        return [*attends[:-1], [attends[-1][0], end]]
    return [*attends, [begin, end]]


def formatted(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``conversations`` (to a fresh folder below the shared one by default) and returns what ``read`` finds in the files.

    Null roles and texts are empty, null turns come first, rows of equal turns are in order of role and text, repeated rows are turns of
    their own; positions are characters of the formatted text, not ids of a tokenizer; an empty table gives none, and columns beside conv_id, turn, role and text are ignored. A shard is a range of conversations:
    first turns that conversations share are emitted once in each shard that has any of them.
    """
    spark = conversations.sparkSession
    path = path or new_path(spark, "chat")
    write(conversations, path)
    return read(spark, path)
