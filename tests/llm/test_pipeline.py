"""The pipeline's stages against plain versions, each on what the stage before kept."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.helpers import ODD, SMALL, documents
from tests.llm.test_dedup import similar_components
from vibrata.llm.common import table


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == columns, name
    rejected, exact, near, mixed, encoded = seen
    assert 0 < len(rejected) <= table(spark, SMALL, "documents").count()
    keep = {}
    for r in rejected:
        keep[r.text or ""] = max(keep.get(r.text or "", r.doc_id), r.doc_id)
    assert sorted(keep.values()) == sorted(r.doc_id for r in exact)
    kept = {r.doc_id for r in near}
    groups = [{exact[i].doc_id for i in g} for g in similar_components([(r.doc_id, r.text) for r in exact])]
    # Each group keeps its smallest document; the fingerprints may miss a pair, never join one that isn't similar.
    assert len(near) == len(kept) and all(min(g) in kept for g in groups) and len(kept) <= len(groups) + 2
    assert {r.doc_id for r in mixed} <= kept and max(Counter(r.doc_id for r in mixed).values()) <= 2
    size, taken = defaultdict(int), defaultdict(int)
    for r in near:
        size[r.source] += len((r.text or "").split())
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.2 * sum(size.values())
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, repeats, long texts and clashing columns: what each stage keeps, stage by stage and chained without files."""
    docs = chained = documents(spark, ODD, True)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs, chained = spark.read.parquet(str(tmp_path / str(k))), stage(spark, chained, SMALL)
        seen.append(docs.collect())
    accepted, exact, near, mixed, encoded = ([r.doc_id for r in rows] for rows in seen)
    texts = Counter(r.text or "" for r in seen[0])
    assert len(exact) == len(texts) and set(exact) <= set(accepted)
    assert len(near) == len(similar_components([(r.doc_id, r.text) for r in seen[1]]))
    assert sorted(map(str, encoded)) == sorted(map(str, mixed)) and set(mixed) <= set(near)
    assert sorted(map(str, (tuple(r) for r in chained.collect()))) == sorted(map(str, (tuple(r) for r in seen[4])))


def test_an_empty_table_passes_all_stages(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0 and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
