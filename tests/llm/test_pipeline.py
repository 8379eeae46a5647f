from __future__ import annotations

from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import edge_rows  # noqa: E402
from .test_ngram_join import brute_kept  # noqa: E402
from .test_operators import check_packing  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_edge_rows(spark, edge):
    docs, rows = edge, edge_rows()
    known = pipeline.known_language(spark, docs, "")
    assert known.columns == COLUMNS
    assert Counter(r["doc_id"] for r in known.collect()) == Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    one = pipeline.one_of_near_copies(spark, docs, "")
    assert one.columns == COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == brute_kept(rows)
    clean = pipeline.without_personal_data(spark, docs, "")
    assert clean.columns == COLUMNS and clean.count() == len(rows)
    mixed = pipeline.mixed(spark, docs, "")
    assert mixed.columns == COLUMNS
    times = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert max(times.values()) <= 3 * max(Counter((r[0], r[1]) for r in rows).values())
    check_packing(rows, pipeline.packed(spark, docs, "").collect(), 2048)


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_nothing(spark, empty, stage):
    assert pipeline.STAGES[stage][1](spark, empty, "").count() == 0


def test_run_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    pieces = pipeline.run(spark, d).collect()
    assert {p["doc_id"] for p in pieces} <= set(docs) and len(pieces) > 100
