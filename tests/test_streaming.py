from pyspark.sql import functions as F

from potentia.operators import relational as R
from potentia.operators import sequence as S
from potentia.streaming import paths, rollouts

SCHEMA = "path_id long, pos long, token string, score double"


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = [(p, i, "t", ((p * 7 + i * 13) % 65) / 64) for p in range(20) for i in range(1, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(2):
        df.where(f"path_id % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        q = paths.significant_drops(paths.read_paths(spark, f"{tmp_path}/in", SCHEMA, 1), f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("path_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.significant(df).select("path_id", "pos").collect()))


def files(df, at, parts=3):
    for part in range(parts):
        df.where(f"hash(rollout) % {parts} in ({part}, {-part})").coalesce(1).write.mode("append").parquet(at)


def test_rollouts_as_they_come(spark, tmp_path):
    schema = "path_id long, pos long, rollout long, correct boolean, at timestamp"
    rows = spark.range(600).selectExpr("id % 5 path_id", "id % 3 pos", "id rollout", "id % 7 < 3 correct", "timestamp_seconds(1700000000 + id * 10) at")
    again = rows.unionByName(rows.limit(50))
    files(again, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scores = rollouts.position_scores(stream, "path_id", "pos").writeStream.outputMode("complete").format("memory").queryName("own_scores").trigger(availableNow=True).start()
    scores.awaitTermination()
    want = {(r.path_id, r.pos): (r.n, r.s) for r in rows.groupBy("path_id", "pos").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("s")).collect()}
    got = {(r.path_id, r.pos): (r.n, r.score) for r in spark.table("own_scores").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s) < 1e-12 for k, (n, s) in want.items())
    timed = rollouts.accuracy_over_time(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "10 minutes", "1 day", "path_id")
    q = timed.writeStream.outputMode("update").format("memory").queryName("own_accuracy").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("own_accuracy").agg(F.sum("n")).first()[0] == again.count()


def test_latest_rows_of_a_stream(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 40 uid", "id rollout", "id * 3 % 101 value")
    files(rows, f"{tmp_path}/in")
    stream = spark.readStream.schema("uid long, rollout long, value long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rollouts.upsert(stream, f"{tmp_path}/out", f"{tmp_path}/check", ["uid"], "rollout").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out")
    newest = last.where(F.col("version") == last.agg(F.max("version")).first()[0]).drop("version")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, R.last_wins(rows, ["uid"], "rollout").collect()))
