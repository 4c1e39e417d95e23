"""Text search that opens only files that can hold the text."""

import random

import pytest

from vigilog.operators import search
from vigilog.sources import tables
from vigilog.sources.text_index import TextIndex, grams
from helpers import at


@pytest.fixture
def table(spark, make_logs, tmp_path):
    rng = random.Random(2)
    words = ["timeout", "Ärger", "conn-17", "user=ann", "a.b*c", "日本語のログ", "x", "50%_off"]
    rows = [{"event_id": f"e{i}", "event_type": "t", "timestamp": at(i % 5 * 86400),
             "message": rng.choice([None, "", "ab", " ".join(rng.choices(words, k=3)), f"rare-{i}"])} for i in range(300)]
    path = str(tmp_path / "my logs")
    for part in range(3):
        tables.write_by_day(make_logs(rows[part * 100:(part + 1) * 100]).coalesce(1), path)
    return path


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_grams():
    assert grams("AbCd") == ["abc", "bcd"] and grams("ab") == [] and grams("aaaa") == ["aaa"]


def test_a_search_gives_what_a_full_scan_gives_from_fewer_files(spark, table, tmp_path):
    index = TextIndex(spark, table, str(tmp_path / "index"), buckets=4)
    assert index.update() == 15 and index.update() == 0
    whole = tables.read_table(spark, table)
    some = whole.filter("message like 'rare-%'").first()
    for text in ("TIMEOUT", "ärger", "conn-17 user", "a.b*c", "本語の", "x", "", "0%_", some.message, "nowhere at all", "rare-"):
        found = index.search(text)
        assert ids(found) == ids(search.search_logs(whole, contains=text)), text
        assert sorted(found.columns) == sorted(whole.columns)
    # One file holds the rare word, and no other is opened.
    assert len(index.files(some.message)) < 15 and index.files("nowhere at all") == []
    word = "zebra"
    assert index.files(word) == [] and index.search(word).count() == 0


def test_rare_words_open_only_their_files_and_other_conditions_hold(spark, make_logs, tmp_path):
    path = str(tmp_path / "t")
    for i, word in enumerate(["needle in hay", "hay", "more hay", "haystack"]):
        tables.write_by_day(make_logs([{"event_id": f"e{i}", "message": word, "timestamp": at(i * 86400)}]).coalesce(1), path)
    index = TextIndex(spark, path, str(tmp_path / "index"), buckets=2)
    index.update()
    found = index.search("NEEDLE")
    assert ids(found) == ["e0"] and len(found.inputFiles()) == 1
    assert ids(index.search("hay", since=at(86400), until=at(3 * 86400))) == ["e1", "e2"]
    assert ids(index.search("hay", service="none")) == []


def test_new_files_are_searched_before_they_are_indexed_and_gone_ones_are_not_missed(spark, make_logs, tmp_path):
    path = str(tmp_path / "t")

    def add(name, mode="append"):
        make_logs([{"event_id": name, "message": f"word {name}"}]).coalesce(1).write.mode(mode).parquet(path)

    add("one")
    index = TextIndex(spark, path, str(tmp_path / "index"))
    assert ids(index.search("word one")) == ["one"]  # no index yet
    index.update()
    add("two")
    assert ids(index.search("word two")) == ["two"] and len(index.files("word two")) == 1
    assert index.update() == 1 and index.files("word")[0] and len(index.files("word ")) == 2
    add("three", mode="overwrite")
    assert ids(index.search("word")) == ["three"] and index.search("word one").count() == 0
    assert index.update() == 1 and ids(index.search("word three")) == ["three"]


def test_an_update_that_broke_off_changes_nothing(spark, make_logs, tmp_path):
    path, root = str(tmp_path / "t"), str(tmp_path / "index")
    make_logs([{"event_id": "a", "message": "abcdef"}]).coalesce(1).write.parquet(path)
    index = TextIndex(spark, path, root)
    # Postings without the list of files that ends an update.
    spark.createDataFrame([("zzz", "nothing", 0)], "gram string, file string, bucket int").write.partitionBy(
        "bucket").parquet(f"{root}/grams/batch=0")
    assert ids(index.search("abc")) == ["a"]
    index.update()
    assert ids(index.search("abc")) == ["a"] and index.files("zzz") == []


def test_very_long_and_repeated_messages(spark, make_logs, tmp_path):
    path = str(tmp_path / "t")
    long = "ab " * 300_000 + "the end"
    make_logs([{"event_id": "a", "message": long}, {"event_id": "b", "message": long}, {"event_id": "c"}]).write.parquet(path)
    index = TextIndex(spark, path, str(tmp_path / "index"))
    index.update()
    assert ids(index.search("THE END")) == ["a", "b"] and index.files("ba ") == []
