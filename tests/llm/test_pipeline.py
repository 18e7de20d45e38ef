"""The corpus pipeline on the smallest tables, and its SQL-expressible queries against DuckDB."""
import pytest

import corpus_pipeline
from flotsam.llm.queries import ORACLES, QUERIES
from flotsam.session import materialise


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    from oracle_check import compare, connect

    assert compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name])[0] == "ok"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dup", "mixing", "tokens"]
    cols, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf))
        assert docs.columns == cols
        seen.append(docs)
    start, clean, single, apart, mixed = (d.select("doc_id").toPandas()["doc_id"] for d in seen)
    assert set(apart) < set(single) < set(clean) < set(start) and single.is_unique and set(mixed) <= set(apart)
    assert mixed.value_counts().max() <= 3 and len(mixed) > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(mixed) and all(r.decoded == texts[r.doc_id] and len(r.ids) == 4 * r.n_tokens for r in last)
