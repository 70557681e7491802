from pyspark.sql import functions as F

import cases
import corpus_pipeline
from siftmill.llm import langid
from siftmill.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "exact_dedup", "simhash_near_dedup", "packing"]


def folder(spark, tmp_path, rows, labels=()):
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_on_odd_rows(spark, tmp_path):
    """Columns stay as they are, and every stage's decision is that of its operator."""
    sf_dir = folder(spark, tmp_path, cases.rows())
    docs = cases.clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("kept", "keep_id", "component_id", "fp", "stratum", "score"))
    ids = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString()
        ids[name] = sorted({r["doc_id"] for r in out.select("doc_id").collect()}, key=repr)
    assert not {4, 5, 6, 8} & set(ids["language_id"]) and {1, 3, 11} <= set(ids["language_id"])
    assert {1, 3} <= set(ids["quality_rules"]) and not {4, 5, 6, 12, 13} & set(ids["quality_rules"])
    assert 3 in ids["exact_dedup"] and not {1, 2} & set(ids["exact_dedup"])
    assert 1 in ids["simhash_near_dedup"] and not {2, 3, 5, 6} & set(ids["simhash_near_dedup"])


def test_run_against_the_stages_by_hand(spark):
    """What is packed is what the rules, applied one by one in plain Python, keep."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    kept = {i: t for i, t in texts.items() if langid.predict_texts([t], model)[1][0] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    chosen = stage("quality_rules")(spark, docs.filter(F.col("doc_id").isin(list(kept))), SF)
    kept = {i: kept[i] for i in (r["doc_id"] for r in chosen.select("doc_id").collect())}
    last = {}
    for i, text in kept.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        last[key] = max(i, last.get(key, i))
    kept = sorted(last.values())
    prints = {i: fingerprint(texts[i]) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(kept):
        for j in kept[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {i for i in kept if find(i) == i}
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], [r["doc_tokens"], 0])[1] += r["length"]
    assert all(total == sum_ for total, sum_ in whole.values())


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).collect() == []
