import datetime as dt

from echolot.streaming import arrivals

SCHEMA = "path string, content_hash string, byte_size bigint, modified timestamp"


def write(spark, folder, *rows):
    now = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(p, h, s, now) for p, h, s in rows], SCHEMA).write.mode("append").parquet(str(folder))


def test_running_groups(spark, tmp_path):
    write(spark, tmp_path / "in", ("/a", "x", 5), ("/b", "x", 5), ("/c", "y", 7))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = arrivals.duplicate_arrivals(stream).writeStream.outputMode("update").format("memory").queryName("groups").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("groups").collect()] == [("x", 2, "/a", 5)]


def test_follow(spark, tmp_path):
    known, check = str(tmp_path / "known"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    write(spark, tmp_path / "in", ("/a", "x", 5), ("/b", "x", 5))
    arrivals.follow(stream(), known, check).awaitTermination()
    write(spark, tmp_path / "in", ("/c", "x", 5), ("/d", "z", 5))
    arrivals.follow(stream(), known, check).awaitTermination()
    got = {r.path: r.duplicate_of for r in spark.read.parquet(known).collect()}
    assert got == {"/a": None, "/b": "/a", "/c": "/a", "/d": None}
