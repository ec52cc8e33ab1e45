import brute
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"


def pipeline_by_hand(rows, items, path):
    """[(doc_id, text, source)] through all stages."""
    judged = [(d, t, s, brute.quality(t)[-1]) for d, t, s in rows]
    hosts = {}
    for _, _, s, failed in judged:
        n, f = hosts.get(s, (0, 0))
        hosts[s] = n + 1, f + failed
    rates = [f / n for n, f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    weight = max(1.0, min(10000.0, m * (1 - m) / v - 1)) if v else 10000.0
    bad = {s for s, (n, f) in hosts.items() if (f + weight * m) / (n + weight) > 0.5}
    docs = [(d, t) for d, t, s, failed in judged if not failed and s not in bad]
    found = brute.jaccard(docs)
    docs = [row for row, (d, n, c) in zip(docs, found) if n == 0 or d == c]
    kept = {row[0]: row[5].decode("utf-8", "ignore") for row in brute.repeats(docs)}
    docs = [(d, kept[d]) for d, _ in docs]
    docs = [row for row, x in zip(docs, brute.contaminated(docs, items)) if not x[-1]]
    return sorted(brute.bpe(docs, path))


def test_pipeline_agrees_with_brute_force(spark):
    import public_tokenizers

    import corpus_pipeline

    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == pipeline_by_hand(rows, items, public_tokenizers.path("byte_bpe_50k.json"))


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, DATA)
        assert docs_after.dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
