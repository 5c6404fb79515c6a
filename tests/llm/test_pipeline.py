"""The pipeline's stages, each on its own input, and the whole against its parts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starsift.llm import mixing, queries, secrets


@pytest.fixture(scope="module")
def stages(spark, sf):
    from starsift.storage import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixture", "bpe"]
    for table in stages[1:-1]:
        assert table.columns == stages[0].columns
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_clean_documents_stay(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0")
    before, after = stages[0].join(labels, "doc_id", "left_semi").count(), stages[1].join(labels, "doc_id", "left_semi").count()
    assert after >= 0.99 * before
    assert stages[2].select("text").distinct().count() == stages[2].count()
    assert stages[3].count() == stages[2].count()
    for r in stages[3].select("text").collect():
        assert not [s for s in secrets.find(r["text"] or "") if s[2] in secrets.BASE_RULES]


def test_mixture_and_tokens(stages):
    size = F.sum(F.size(F.split(F.trim("text"), r"\s+")))
    assert 1.4 < stages[4].agg(size).first()[0] / stages[3].agg(size).first()[0] < 1.6
    assert stages[5].count() == stages[4].count()
    expected = sorted((r["doc_id"], r["h"]) for r in stages[4].select("doc_id", F.sha2("text", 256).alias("h")).collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in stages[5].collect()) == expected


def test_run_is_the_stages_and_leaves_its_input_only(spark, sf, stages):
    from pathlib import Path

    from starsift.storage import shared_dir

    tables = lambda: {p.name for p in Path(shared_dir(spark)).iterdir() if re.fullmatch(r"[a-z_]+-[0-9a-f]{32}", p.name)}
    before = tables()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[-1].collect()))
    (left,) = tables() - before
    assert left.startswith("mixture-")


def test_the_mixture_is_in_the_order_of_its_slots(spark, sf, stages):
    rows = mixing.mixed(stages[3], slot_col="slot").orderBy("slot", "doc_id").select("doc_id", "text").collect()
    assert corpus_pipeline.mix_sources(spark, stages[3], sf).select("doc_id", "text").collect() == rows


def test_empty_documents(spark, sf, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_odd_documents(spark, sf):
    """Nulls in every column, repeated rows, ties, long texts, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, own string, rid string, blob string, mix_row string, score string, text_hash string"
    long = "some words of a long text " * 3000
    rows = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, "one two three four five six eight"), (5, long), (None, "no id here but some words"), (None, None)]
    docs = spark.createDataFrame([(k, t, None, "a" if k else None, len(t) if t else None, *["clash"] * 6) for k, t in rows], schema)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert {tuple(r[5:]) for r in docs.collect()} == {("clash",) * 6}
        sizes.append(docs.count())
    # All are clean; 1, 2 and the null text are one class, 3 and 4 another; only texts with words are mixed.
    assert sizes[:3] == [8, 4, 4] and {r["doc_id"] for r in docs.collect()} <= {3, 5, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == sizes[3]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.queries()) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
