"""The ways taken where a side is too large to be broadcast give the same rows."""

from __future__ import annotations

import pytest

from vistrel.llm import decontamination, near_dedup, substring_dedup


@pytest.mark.parametrize(
    ("module", "run"),
    [
        (decontamination, lambda docs, bench: decontamination.contaminated(docs, bench)),
        (near_dedup, lambda docs, bench: near_dedup.near_components(docs)),
        (substring_dedup, lambda docs, bench: substring_dedup.repeated_passages(docs)),
    ],
)
def test_same_rows(spark, sf_dir, monkeypatch, module, run):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    small = sorted(map(str, run(docs, bench).collect()))
    monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    assert sorted(map(str, run(docs, bench).collect())) == small
