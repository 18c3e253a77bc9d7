from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from evigraph.llm import chat


@given(st.text(alphabet="a\\<[|>lb]/s\n"), st.sampled_from(["user", "assistant", "", "<|x|>\n"]))
def test_escapes_are_reversible(text, role):
    line, begin, end = chat.segment(role, text)
    assert chat.parsed(line) == (role, text)
    body = line[line.index("|>\n") + 3 : -len("<|end|>\n")]
    assert not any(mark in body for mark in ("<|", "</s>", "[INST]", "[/INST]"))
    assert chat.unescaped(line[begin:end]) == (text if role == "assistant" else "")


def plain(rows):
    by: dict = {}
    for c, n, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.segment(r, t)[0]) for r, t in turns)))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, node string"


def rows():
    rng, out = random.Random(2), []
    for c in range(60):
        system = rng.choice(["be brief", "[INST]", "é"])
        turns = [("system", system)] + [(("user", "assistant")[k % 2], rng.choice(["yes", "no", "</s>[INST] ok [/INST]", "", None])) for k in range(rng.randint(0, 6))]
        out += [(c, k, r, t, "x") for k, (r, t) in enumerate(turns)]
    return out + [(None, 1, "user", "a", "x"), (None, None, None, None, "x"), (5, 0, "system", "again", "x"), (61, 0, "user", "b" * 200000, "x")] + out[:1]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    got = chat.formatted(spark.createDataFrame(rows(), SCHEMA).repartition(5), path)
    assert sorted(map(tuple, got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=str) == plain(rows())
    segments = spark.read.parquet(f"{path}/segments").collect()
    assert len(segments) < len(rows())
    for shard in {s.shard for s in segments}:
        mine = sorted((s for s in segments if s.shard == shard), key=lambda s: s.seq)
        assert len({s.node for s in mine}) == len(mine)
        for s in mine:
            assert sum(z - a for a, z in s.attends) == s.position and all(z <= s.place for _, z in s.attends)
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_is_found(spark, tmp_path):
    path, other = str(tmp_path / "c"), str(tmp_path / "d")
    chat.write(spark.createDataFrame(rows(), SCHEMA), path)
    spark.read.parquet(f"{path}/segments").where("seq != 1").write.parquet(f"{other}/segments")
    spark.read.parquet(f"{path}/members").write.parquet(f"{other}/members")
    with pytest.raises(Exception, match="doesn't follow"):
        chat.read(spark, other).count()
