import os

import pytest
from pyspark.sql import functions as F

from helixframe.llm import common as x


def test_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        for value, want in (("64m", f"{x.BATCH_BYTES}b"), ("1m", "1m"), ("67108864b", f"{x.BATCH_BYTES}b"), ("4096", "4096")):
            spark.conf.set(key, value)
            x.small_batches(spark.range(1))
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_keep_only(spark, monkeypatch, bound):
    monkeypatch.setattr(x, "GONE_ROWS", bound)
    rows = [(1, "a", 1), (2, "a", 2), (2, "a", 3), (3, None, 4), (None, "b", 5), (None, "b", 6), (4, "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    groups = x.written(df.select("doc_id", sha.alias("sha"), F.coalesce("text", F.lit("")).alias("g")), "g")
    got = sorted((tuple(r)[:2] for r in x.keep_only(df, groups, "g", F.max).collect()), key=repr)
    assert got == sorted([(2, "a"), (3, None), (None, "b"), (4, "c")], key=repr)


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(x, "RANK_ROWS", 3)
    df = x.written(spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("b").alias("k")), "r")
    by = {}
    for r in x.ranked(df, ["k"], ["id"], 1000).collect():
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 1000


def test_ranks_need_one_shuffle_of_the_rows(spark):
    df = x.written(spark.range(100).select("id", F.lit("a").alias("k"), F.col("id").cast("string").alias("text")), "r")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = x.ranked(df, ["k"], ["id"], 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [row_number" in line)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[join:window])


def test_the_shared_folder(spark):
    class Far:
        conf, sparkContext = {}, type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        x.shared_path(Far, "t")
    Far.sparkContext.master = "local[2]"
    assert x.shared_path(Far, "t").startswith("file:")
    Far.conf = {"spark.checkpoint.dir": "hdfs://n/shared/"}
    Far.sparkContext.master = "yarn"
    assert x.shared_path(Far, "t").startswith("hdfs://n/shared/t-")
    before, mark = x.written(spark.range(3), "zero"), x.made_so_far()
    tables = [x.written(spark.range(3), "one"), x.written(spark.range(3), "two")]
    files = [f.removeprefix("file://") for t in tables for f in t.inputFiles()]
    assert all(map(os.path.exists, files))
    last = x.settled(tables[1].where("id > 0"), "three", mark)
    assert last.count() == 2 and before.count() == 3 and not any(map(os.path.exists, files)) and x.made_so_far() == mark + 1


def test_files_grow_with_the_input(spark, monkeypatch, tmp_path):
    spark.range(200_000).repartition(50).write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t")).repartition(100)
    monkeypatch.setattr(x, "FILES_PER_CORE", 1)
    assert x.gathered(many).rdd.getNumPartitions() == 4
    monkeypatch.setattr(x, "FILE_BYTES", 1 << 16)
    assert 10 < x.gathered(many).rdd.getNumPartitions() <= 100


def test_any_column(spark):
    df = spark.sql("select cast(id % 2 as long) as doc_id, 'a' as text, map('k', id) as m, id as _all, id as _hash, id as _k0, id as _bucket, id as _own, id as _start, id as _n from range(6)")
    groups = x.written(df.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").alias("g")), "g")
    (r,) = x.keep_only(df, groups, "g", F.max).collect()
    assert r.doc_id == 1 and [tuple(r)] == [tuple(q) for q in x.keep_only(df.repartition(3), groups, "g", F.max).collect()]
    got = x.ranked(df, ["doc_id"], ["_all"], 6).collect()
    assert got[0].__fields__ == [*df.columns, "rank"] and sorted((q.doc_id, q["rank"]) for q in got) == [(i, j) for i in (0, 1) for j in range(3)]
    none = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")
    groups = x.written(none.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").alias("g")), "g")
    for best, kept in ((F.min, [(None, "a"), (None, "b")]), (F.max, [(4, "a"), (None, "b")])):
        assert sorted(map(tuple, x.keep_only(none, groups, "g", best).collect()), key=repr) == kept
