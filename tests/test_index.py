import pytest
from pyspark.sql import functions as F

from lodeworks.operators import index as X
from lodeworks.operators.shared import scratch, shared_path, shared_table


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, vector array<double>, sheet string")


def state(spark, path):
    post = sorted(map(tuple, X.postings(spark, path).collect()))
    return post, sorted((r.id, tuple(r.vector)) for r in X.vectors(spark, path).collect())


BASE = [(i, f"word{i % 7} common text {i}", [float(i), 1.0]) for i in range(200)]


def test_refresh_equals_a_rebuild(spark, tmp_path):
    path, other = f"{tmp_path}/index", f"{tmp_path}/rebuilt"
    assert {r.state: r.chunks for r in X.refresh(spark, path, frame(spark, BASE)).collect()} == {"added": 200}
    steps = [
        BASE[2:] + [(500, "new words", None), (501, None, [2.0, 2.0])],
        [(i, t + " more" if i % 100 == 5 else t, v) for i, t, v in BASE],
        [(i, t, [0.0, v[0]] if i == 9 else v) for i, t, v in BASE if i != 20] + [(None, "no id", None), (3, "a second row", None)],
        [],
        BASE[:3],
    ]
    for k, rows in enumerate(steps):
        told = {r.state: r.chunks for r in X.refresh(spark, path, frame(spark, rows)).collect()}
        X.refresh(spark, f"{other}{k}", frame(spark, rows))
        assert state(spark, path) == state(spark, f"{other}{k}"), k
        assert sum(n for s, n in told.items() if s != "gone") == len({r[0] for r in rows if r[0] is not None})
    assert told == {"added": 3}
    X.compacted(spark, path)
    before = state(spark, path)
    X.vacuum(spark, path)
    assert state(spark, path) == before and len(X.manifests(spark, path)) == 1
    assert {r.state for r in X.refresh(spark, path, frame(spark, BASE[:3])).collect()} == {"same"}


def test_a_refresh_writes_what_differs(spark, tmp_path):
    path = f"{tmp_path}/index"
    X.refresh(spark, path, frame(spark, BASE))
    told = {r.state: r.chunks for r in X.refresh(spark, path, frame(spark, [(i, t + " more" if i in (5, 105) else t, v) for i, t, v in BASE[1:]])).collect()}
    assert told == {"same": 197, "changed": 2, "gone": 1}
    written = spark.read.parquet(f"{path}/postings/generation-2")
    assert {r.id for r in written.collect()} == {5, 105} and spark.read.parquet(f"{path}/entries/generation-2").count() == 3
    X.refresh(spark, path, frame(spark, [(i, t + " more" if i in (5, 105) else t, v) for i, t, v in BASE[1:]]))
    assert [r["generation"] for r in X.manifests(spark, path)] == [1, 2]


def test_a_failed_refresh_leaves_no_trace(spark, tmp_path):
    path = f"{tmp_path}/index"
    X.refresh(spark, path, frame(spark, BASE))
    before = state(spark, path)
    bad = frame(spark, BASE[:50]).withColumn("text", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.concat("text", F.lit("!"))))
    with pytest.raises(Exception, match="lost"):
        X.refresh(spark, path, bad)
    assert state(spark, path) == before
    X.refresh(spark, path, frame(spark, BASE[:2]))
    assert {i for _, i in state(spark, path)[0]} == {0, 1}


def test_no_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        X.postings(spark, f"{tmp_path}/none")


def test_scratch_deletes_what_it_made(spark):
    with scratch(spark):
        path = shared_path(spark, "t")
        spark.range(3).write.parquet(path)
        kept = shared_table(spark.range(5).toDF("x"), "t").collect()
    assert len(kept) == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_postings_stay_where_they_are(spark, tmp_path):
    # Two generations: what of the first is out of date is brought to the postings; these are not shuffled by id.
    path = f"{tmp_path}/index"
    X.refresh(spark, path, frame(spark, BASE))
    X.refresh(spark, path, frame(spark, [(i, t + " more" if i == 5 else t, v) for i, t, v in BASE[1:]]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = X.postings(spark, path)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert {i for t, i in rows.collect() if t == "more"} == {5} and {i for _, i in rows.collect()} == set(range(1, 200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
