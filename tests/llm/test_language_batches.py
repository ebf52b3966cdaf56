"""Language batches hold few texts at once, whatever the sizes of batches handed over."""

from helixframe.llm import language


def test_few_texts_are_counted_at_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.trained(docs)
    kept = language.keep_known(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
    column = docs.select("doc_id", "text").orderBy("doc_id").toArrow()
    rejected = model.predict(column.column("text").combine_chunks())[2]
    want = sorted(i for i, r in zip(column.column("doc_id").to_pylist(), rejected.tolist(), strict=True) if not r)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want
    # A worker's vectors: some ten arrays of 8 bytes a cell and row.
    assert language.TEXT_ROWS * language.CELLS * 8 <= 2 << 20
