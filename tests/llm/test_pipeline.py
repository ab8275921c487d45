"""Each stage on its own input against a plain version, and the stages in a row."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_near_dedup import brute
from vistrel.llm.common import materialise


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(materialise(stage(spark, kept[-1], sf_dir), f"test{k}"))
    assert all(df.columns == docs.columns for df in kept[:-1])
    start, good, unique, alone, clean = ({r["doc_id"]: r["text"] for r in df.collect()} for df in kept[:-1])
    judged = [i for i in start if i in labels]
    assert sum(labels[i] == (i in good) for i in judged) >= 0.9 * len(judged)
    assert set(unique) == set({lowered(t): i for i, t in sorted(good.items())}.values())
    assert set(alone) == {i for i, (_, root) in brute(list(unique.items())).items() if i == root}
    assert set(clean) == {i for i, t in alone.items() if not any(x in t for x in items)}
    assert {r["doc_id"] for r in kept[-1].collect()} == set(clean)


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_on_edge_rows_and_an_empty_table(spark, sf_dir, documents, edge_rows):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null").first()["text"]
    rows = [*edge_rows, (None, f"no id, but {item}"), (900, f"{item} and an id")]
    docs = documents(rows)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert set(texts(kept)) <= set(texts(docs)), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    unique = texts(stages["exact dedup"](spark, docs, sf_dir))
    assert sorted(lowered(t) for _, t in unique) == sorted({lowered(t) for _, t in rows})
    assert not any(item in t for _, t in texts(stages["benchmark decontamination"](spark, docs, sf_dir)))
    near = texts(stages["MinHash near-dedup"](spark, docs, sf_dir))
    assert sum(t == edge_rows[-1][1] for _, t in near) == 1 and sum(i == "None" for i, _ in near) == 3
    packed = stages["best-fit packing"](spark, docs, sf_dir).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows)
    assert stages["best-fit packing"](spark, docs.limit(0), sf_dir).count() == 0


def test_run_on_edge_rows(spark, sf_dir, documents, edge_rows, tmp_path):
    documents(edge_rows).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} <= {i for i, _ in edge_rows}
