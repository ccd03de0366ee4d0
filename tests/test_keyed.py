import pytest
from pyspark.sql import functions as F

from ledgerline.sources.keyed import Conflict, KeyedTable

SCHEMA = "k string, at long, v string"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)


def test_upsert_insert_delete_and_old_versions(spark, table):
    assert held(table) == [] and table.versions() == []
    table.upsert(rows(spark, ("a", 1, "x"), ("b", 1, "x"), ("a", 3, "z"), ("a", 2, "y")), F.col("at"))
    table.insert_new(rows(spark, ("a", 9, "no"), ("c", 2, "late"), ("c", 1, "first")), F.col("at"))
    assert held(table) == [("a", 3, "z"), ("b", 1, "x"), ("c", 1, "first")]
    table.upsert(rows(spark, ("b", 0, "replaced")), F.col("at"))
    table.delete(rows(spark, ("a", 0, ""), ("zz", 0, "")).select("k"))
    assert held(table) == [("b", 0, "replaced"), ("c", 1, "first")]
    assert held(table, 1) == [("a", 3, "z"), ("b", 1, "x")]
    assert table.vacuum() > 0 and table.versions() == [4]
    assert held(table) == [("b", 0, "replaced"), ("c", 1, "first")] and table.vacuum() == 0


def test_null_keys_and_empty_changes(spark, table):
    table.upsert(spark.createDataFrame([], SCHEMA))
    table.upsert(rows(spark, (None, 1, "n"), ("a", 1, None)))
    assert {(k, v) for k, _, v in table.read().collect()} == {(None, "n"), ("a", None)}


def test_a_replayed_batch_changes_nothing(spark, table):
    assert table.upsert(rows(spark, ("a", 1, "x")), name="s", number=0) and table.upsert(rows(spark, ("a", 2, "y")), name="s", number=1)
    assert not table.upsert(rows(spark, ("a", 1, "x")), name="s", number=0) and not table.upsert(rows(spark, ("a", 2, "w")), name="s", number=1)
    assert held(table) == [("a", 2, "y")] and table.seen("s") == 1 and table.seen("other") == -1


def test_a_kill_between_write_and_commit_leaves_the_table_as_it_was(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1, "x"), ("b", 1, "x")), name="s", number=0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows(spark, ("a", 2, "y"), ("c", 2, "y")), name="s", number=1)
    assert held(table) == [("a", 1, "x"), ("b", 1, "x")] and table.seen("s") == 0
    assert table.upsert(rows(spark, ("a", 2, "y"), ("c", 2, "y")), name="s", number=1)
    assert held(table) == [("a", 2, "y"), ("b", 1, "x"), ("c", 2, "y")]
    assert table.vacuum() == 1  # what the first try wrote; b still lies where the first version put it


def test_one_of_two_writers_wins(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1, "x")))
    old = table.manifest()
    table.upsert(rows(spark, ("b", 1, "x")))
    monkeypatch.setattr(table, "manifest", lambda version=None: old)
    with pytest.raises(Conflict):
        table.upsert(rows(spark, ("c", 1, "x")))
    monkeypatch.undo()
    assert held(table) == [("a", 1, "x"), ("b", 1, "x")]


def test_only_touched_buckets_are_written_and_few_files_stay(spark, table):
    table.upsert(spark.range(200).select(F.col("id").cast("string").alias("k"), "id", F.lit("v")).toDF("k", "at", "v").repartition(7))
    first = table.manifest()["buckets"]
    for i in range(3):
        table.upsert(rows(spark, ("5", 1000 + i, "new")))
    now = table.manifest()["buckets"]
    assert sum(first[b] != now[b] for b in now) == 1 and len(first) == len(now) == 4
    assert len(table.read().inputFiles()) == 4
    assert KeyedTable(spark, table.path, SCHEMA, ["k"], buckets=99).buckets == 4  # a table keeps its number of buckets


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from ledgerline.sources import keyed

    monkeypatch.setattr(keyed, "FILE_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put such small parts together again
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ["k"], buckets=2)
    for n in range(2):
        table.upsert(spark.range(n * 500, 1000).selectExpr("id AS k", f"{n}L AS v"), name="rows", number=n)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[1] for r in table.read().groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 400
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(k, int(k >= 500)) for k in range(1000)]
