"""The pipeline's stages against plain Python on the smallest tables, and their SQL where there is some."""

import re
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quillmesh.llm import common, registry
from quillmesh.sources.messages import TABLES

sys.path.insert(0, str(Path(__file__).parent))
from test_corpus_ops import plain_fingerprint, roots  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.saved(stage(spark, docs, sf), "test-stage")
        if name != "packing":
            assert docs.columns == before.columns
        seen.append((before.collect(), docs.collect()))
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    best = {}
    for r in seen[1][0]:
        best[norm(r)] = min(best.get(norm(r), (0, 1 << 62)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in seen[1][1]) == sorted(i for _, i in best.values())
    prints = [plain_fingerprint(r.text) for r in seen[2][0]]
    least = {}
    for r, g in zip(seen[2][0], roots(prints)):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in seen[2][1]) == sorted(least.values())
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert words(seen[3][1]) == pytest.approx(words(seen[3][0]), rel=0.25)
    times = defaultdict(int)
    for r in seen[3][1]:
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    assert {r.doc_id for r in seen[4][1]} == set(times)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())
