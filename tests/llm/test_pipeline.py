import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "jaccard_join", "substring_dedup", "mixing", "bpe"]
    assert pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The table that each stage is given and the one it gives."""
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        found.append((docs, spark.read.parquet(path)))
        docs = found[-1][1]
    return found


def test_each_stage_does_its_part(spark, sf, stages):
    from tests.llm.test_dedup import brute_groups, brute_kept

    (docs, good), (_, single), (_, cut), (_, mixed), (_, encoded) = stages
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes == docs.dtypes

    clean = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").join(docs, "doc_id", "left_semi")
    assert good.join(clean, "doc_id", "left_semi").count() >= 0.99 * clean.count()
    assert good.count() < docs.count()

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({g for _, _, g in brute_groups(rows)})

    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    expected = {i: (n, gone) for i, n, gone, _ in brute_kept(rows)}
    texts = dict(rows)
    for r in cut.collect():
        n, gone = expected[r["doc_id"]]
        assert len(r["text"].encode().split()) == n - gone
        assert gone or r["text"] == texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])

    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in cut.collect()}
    total = sum(sizes.values())
    assert abs(sum(sizes[r["doc_id"]] for r in mixed.collect()) - 1.5 * total) < 0.05 * total
    assert encoded.count() == mixed.count()


def test_run_applies_the_stages(spark, sf, stages):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in df.collect())
    assert key(pipeline.run(spark, sf)) == key(stages[-1][1])


NAMES = ("n_words", "n_removed", "kept_text", "_text", "row", "key", "_key", "mark", "score", "component_id", "n_shingles", "k", "id", "data", "copies", "size", "source_size", "ids", "n_tokens", "other_0", "none", "best", "stays")


def test_odd_documents(spark, sf, documents):
    """Each stage by itself: names that operators use, nulls, empty and repeated rows, an empty table."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "long text " * 30_000), (5, "one"), (5, "two words here")]
    for name, stage in pipeline.STAGES:
        for some in (rows, []):
            docs = documents(some)
            for c in NAMES:
                docs = docs.withColumn(c, F.lit("x"))
            after = stage(spark, docs, sf)
            if name != "bpe":
                assert after.columns == docs.columns
                assert all(r[c] == "x" for r in after.collect() for c in NAMES)
            else:
                assert after.filter("n_tokens <> size(ids)").count() == 0
            assert some or after.count() == 0


def test_texts_that_share_an_id_stay(spark, documents, sf):
    """Only the copy goes, not the other text of its id; repeated rows leave one; rows without an id count."""
    copy, other, third = ("w%d " * 9 % tuple(range(k, k + 9)) for k in (0, 20, 40))
    rows = [(3, copy), (7, copy), (7, other), (8, third), (8, third), (None, third), (None, "lone words of a text"), (9, ""), (9, ""), (None, None)]
    found = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, documents(rows), sf).collect()), key=repr)
    assert found == sorted([(3, copy), (7, other), (8, third), (None, "lone words of a text"), (9, ""), (9, ""), (None, None)], key=repr)


def test_rows_travel_to_workers_in_small_batches(spark, documents):
    import pyarrow as pa

    from segtide.llm.common import BATCH

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"size": [batch.nbytes], "n": [batch.num_rows]})

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in pipeline.STAGES:
        if name in ("jaccard_join", "substring_dedup", "bpe"):
            spark.conf.unset(bound)
            stage(spark, documents([(k, f"word{k} " * 20) for k in range(3)]), "")
            texts = spark.range(200, numPartitions=1).selectExpr("id", "repeat('word ', 20000) AS text")
            found = texts.mapInArrow(sizes, "size long, n long").collect()
            assert sum(r["n"] for r in found) == 200
            assert max(r["size"] for r in found) < 2 * BATCH
