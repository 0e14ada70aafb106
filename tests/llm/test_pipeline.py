import corpus_pipeline
from gridsight.llm import language, simhash
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_decontaminate import brute as passages
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        if number < 4:
            assert docs.columns == columns and len(after) == docs.count()
        if number == 0:
            bad = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
            assert len(bad & after) <= 0.1 * len(bad) and len(good & after) >= 0.95 * len(good & set(before))
        if number == 1:
            assert all(language.LETTERS.search(before[i]) for i in after) and len(after) >= 0.98 * len(before)
        if number == 2:
            assert after == set(brute_components({k: brute_print(t) for k, t in before.items()}).values())
        if number == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
            assert after == {k for k, _, hit, _ in passages(list(before.items()), items) if not hit}
        if number == 4:
            assert {(r["doc_id"], r["n_tokens"]) for r in docs.collect()} == {(k, len(LIBRARY.encode_ordinary(t))) for k, t in before.items()}
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_empty_and_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "the same words again", "en", "s", 1), (2, "the same words again", "en", "s", 1),
                                 (2, "the same words again", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.one_of_each_group(spark, odd, "").collect()) == [0, 1, 2]
    assert corpus_pipeline.one_of_each_group(spark, odd.limit(0), "").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.keep_language(spark, odd, "").collect()} <= {None, 2}


def test_repeated_doc_id_of_unrelated_texts(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one), (1, two), (2, two), (3, three), (3, one), (3, three)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [(1, one), (1, two), (3, three)]


def test_near_dedup_broadcasts_no_copies_at_anchors(spark, monkeypatch):
    plans, links = [], simhash.links

    def watched(*args):
        found = links(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found
    monkeypatch.setattr(simhash, "links", watched)
    docs = spark.createDataFrame([(i, f"text number {i} of a few") for i in range(30)], "doc_id bigint, text string")
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() > 0
    assert len(plans) == 1 and "Broadcast" not in plans[0]
