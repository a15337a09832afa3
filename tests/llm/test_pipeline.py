import pytest
from test_packing import slow_bins
from test_rules import slow as slow_measures
from test_simhash import slow_components, slow_fingerprint
from test_substrings import slow as slow_removal

import corpus_pipeline
from docweave.llm.neighbours import quality_scores
from docweave.llm.packing import default_vocabulary, encoder
from docweave.llm.rules import quality_rules


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The input of each stage and, last, the result, each written and read again."""
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs[-1], sf_dir).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_rejected_documents_go(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality_scores(steps[0], labels).where("predicted = 1").collect()}
    assert set(rows(steps[1])) == good and 0 < len(good) < steps[0].count()
    kept = {r["doc_id"] for r in quality_rules(steps[1], labels).where("kept").collect()}
    assert set(rows(steps[2])) == kept
    for i, text in rows(steps[1]).items():
        n, _, _, _, repeated = slow_measures(text)
        assert i not in kept or not (n < 20 or 100 * repeated > 30 * n)


def test_one_of_each_group_stays(steps):
    before = sorted(rows(steps[2]).items())
    prints = [slow_fingerprint(t) for _, t in before]
    assert set(rows(steps[3])) == set(slow_components([i for i, _ in before], prints))


def test_repeats_are_cut(steps):
    before = sorted(rows(steps[3]).items())
    want = {i: kept.decode(errors="ignore") for (i, _), (kept, _, _) in zip(before, slow_removal([t.encode() for _, t in before], 200))}
    assert rows(steps[4]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_everything_left_is_packed(steps):
    texts = sorted(rows(steps[4]).items())
    lengths = [len(list(ids)) + 1 for ids in encoder(*default_vocabulary())([t for _, t in texts])]
    out = steps[5].toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {i: n for (i, _), n in zip(texts, lengths)}
    assert out.sequence_id.nunique() == len(slow_bins(out.length.tolist(), 1024))


def test_run_gives_the_same(spark, sf_dir, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(columns).collect())) == sorted(map(tuple, steps[5].select(columns).collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty, blank and very long texts, repeated rows and extra columns whose names clash, stage by stage."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    clash = ["quality_score", "N_WORDS", "cutoffs", "row", "fingerprint_", "removed", "kept_bytes", "text_hash", "salt", "f", "stratum"]
    rows = docs
    long = " ".join(f"word{i}" for i in range(60_000))
    for doc_id, text in ((None, None), (None, ""), (9_000_001, None), (9_000_002, " \n\t"), (9_000_003, long), (9_000_003, long), (9_000_003, long), (None, long)):
        one = {"doc_id": F.lit(doc_id), "text": F.lit(text)}
        rows = rows.unionByName(docs.limit(1).select(*(one.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in docs.columns)))
    rows = rows.select("*", *(F.lit(1).alias(c) for c in clash))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        if name == "best_fit_packing":
            assert out.where("doc_id = 9000003 AND piece = 0").count() == 3 and out.where("doc_id = 9000001").select("length").first()[0] == 1
            continue
        assert out.columns == rows.columns
        found = {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").where("doc_id > 9000000 OR doc_id IS NULL").collect()}
        if name == "quality_rules":
            assert (9_000_001, None) not in found and (9_000_002, " \n\t") not in found
        if name == "simhash_near_dedup":
            assert found == {(9_000_001, None), (9_000_003, long)}
        if name == "suffix_array_dedup":
            assert (9_000_003, "") in found and (9_000_001, None) in found
        assert stage(spark, rows.limit(0), sf_dir).count() == 0
