import corpus_pipeline


def test_pipeline_over_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_every_verbatim_item_is_found(spark, sf_dir):
    import re

    from fernwerk.llm.queries import QUERIES

    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if len(x.split()) >= 8 and x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want)
