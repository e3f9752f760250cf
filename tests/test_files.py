import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming.windows import windowed_summary


def test_loose_csv_drops_index_and_empty_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("index,x,note,y\n0,1.5,a,yes\n1,oops,b,no\n2,2,c,yes\n")
    got = files.read_loose_csv(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((tuple(r.features), r.label) for r in got if r.features[0] is not None) == [((1.5,), "yes"), ((2.0,), "yes")]


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@ATTRIBUTE 'a b' NUMERIC\n@attribute class {x,y}\n@attribute t string\n@data\n1.5,x,'p, q'\n?, y ,z\n")
    got = {tuple(r) for r in files.read_dense_arff(spark, str(tmp_path / "a.arff")).collect()}
    assert got == {(1.5, "p, q", "x"), (None, "z", "y")}


def test_pointer_stub(spark, tmp_path):
    (tmp_path / "p.bin").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 3\n")
    (tmp_path / "q.bin").write_text("data")
    assert [r.oid for r in files.pointer_stubs(spark, str(tmp_path)).collect()] == ["a" * 64]


def test_journal_commits_once(spark, tmp_path):
    df = spark.createDataFrame([("d", "s", "m", "ba", 1, 0.5)], "dataset_id string, split_id string, method string, metric string, seed int, value double")
    j = files.Journal(spark, str(tmp_path / "j"), df.schema)
    assert j.rows().count() == 0 and j.commit(df) == 1 and j.rows().count() == 1
    with pytest.raises(ValueError, match="1 with other values"):
        j.commit(df.withColumn("value", F.lit(0.7)))
    with pytest.raises(ValueError, match="0 with other values"):
        j.commit(df)


def test_shards_and_bundle(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(2, 3)], "k int, y int")
    assert files.union_shards([a, b], ["k"]).count() == 2
    with pytest.raises(ValueError):
        files.union_shards([a, a], ["k"])
    a.write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError):
        files.read_bundle(spark, str(tmp_path / "b"))


def test_stream_matches_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_summary(stream, "ts", ["event_type"], "value").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.mean, 9)) for r in df.collect())
    assert key(spark.table("w")) == key(windowed_summary(events, "ts", ["event_type"], "value"))
