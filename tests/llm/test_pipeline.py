from __future__ import annotations

import random

import corpus_pipeline
from evigraph.llm import decontaminate, simhash


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice(("an", "er", "th", "ou", "st")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    item = text(14)
    docs, labels = [], []
    for i in range(300):
        w = text(rng.randint(30, 90))
        toxic = i % 6 == 0
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), "gruz" + rng.choice(words))
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        if i < 240:
            labels.append((i, 1, int(toxic)))
    docs += [(1000 + k, docs[k][1], "en", "s0", 0) for k in range(1, 9) if k % 6]
    docs += [(2000, " ".join(text(20) + item[:12] + text(20)), "en", "s1", 0), (None, " ".join(text(60)), "en", None, 0), (3000, None, "en", "s2", 0)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, " ".join(item))], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, at, str(tmp_path)).write.parquet(out)
        at = spark.read.parquet(out)
        kept[name] = at
        assert name == "tokens" or at.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    toxic = {i for i in range(300) if i % 6 == 0}
    assert len(ids["toxicity"] & toxic) <= 2 and len(set(range(300)) - toxic - ids["toxicity"]) <= 5
    assert not {1000 + k for k in range(1, 9)} & ids["near_dedup"] and None in ids["near_dedup"]
    groups = simhash.near_duplicates(kept["near_dedup"].where("doc_id is not null"))
    assert groups.where("doc_id != component_id").count() == 0
    assert ids["near_dedup"] - ids["decontamination"] == {2000}
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    assert decontaminate.decontaminate(kept["decontamination"], bench).count() == kept["decontamination"].count()
    assert ids["mixing"] <= ids["decontamination"] and kept["tokens"].count() == kept["mixing"].count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept["tokens"].collect()))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
