"""The corpus pipeline: each stage on all rows of the one before, against brute force."""

import corpus_pipeline
from test_joins import brute_components, brute_leaks

from veinstone.llm import secrets


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        assert k == 4 or docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        kept.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept[0] for i in clean) >= 0.97 * len(clean)
    first = [(i, r.text) for i, r in kept[0].items()]
    assert kept[1].keys() == {c for _, _, c in brute_components(first)}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert kept[2].keys() == kept[1].keys() - {i for i, _ in brute_leaks([(i, r.text) for i, r in kept[1].items()], items)}
    assert kept[3].keys() == kept[2].keys() and all(r.text == secrets.mask_text(kept[2][i].text) and r.n_chars == len(r.text) for i, r in kept[3].items())
    assert kept[4].keys() <= kept[3].keys() and len(kept[4]) > 0.6 * len(kept[3])
