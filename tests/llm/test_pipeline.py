import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from vigilog.llm import packing  # noqa: E402
from vigilog.llm.queries import vocabulary  # noqa: E402


def near(a, b):
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return bool(grams[0] & grams[1]) and 10 * len(grams[0] & grams[1]) >= 8 * len(grams[0] | grams[1])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary_ = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary_, k=n))
    clean = {i: text(rng.randint(60, 120)) for i in range(30)}
    item = text(20)
    passage = text(30)
    rows = dict(clean)
    rows[40] = clean[3]  # an exact copy
    rows[41] = clean[4].rsplit(" ", 2)[0] + " other end"  # a near copy
    rows[42] = text(10) + " " + item + " " + text(10)  # contaminated
    rows[43], rows[44] = text(60) + " " + passage, text(50) + " " + passage + " " + text(40)
    rows[45] = "again " * 100
    rows[46], rows[47], rows[48] = None, "", "few words"
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "sequence_id", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, clean, passage


def test_each_stage_against_plain_rules(spark, corpus):
    folder, rows, clean, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    quality, near_, cut, last = kept.values()
    assert set(quality) == set(rows) - {45, 46, 47, 48}
    assert set(near_) == set(quality) - {40, 41}
    assert all(not near(near_[a].text, near_[b].text) for a in near_ for b in near_ if a < b)
    assert set(cut) == set(near_) and passage not in cut[44].text and passage in cut[43].text
    assert all(cut[i].text == near_[i].text for i in cut if i != 44)
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert set(last) == set(cut) - {42} and set(clean) <= set(last)
    result = corpus_pipeline.run(spark, folder)
    pieces = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in result.collect()}
    want = packing.pieces(docs, vocabulary()).collect()
    assert pieces == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in want}


def test_empty_documents(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("benchmark", "labels", "documents"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
