import random
from collections import Counter

import pytest

from helixframe.llm import mixing as x


@pytest.mark.parametrize("seed", range(30))
def test_deviation_stays_under_one_block(seed):
    rng = random.Random(seed)
    weights = [rng.choice([rng.random(), 10 * rng.random(), 0.001]) + 1e-6 for _ in range(rng.randrange(1, 40))]
    own = x.shares(weights, 1000)
    assert sum(own) == 1000 and min(own) >= 1
    had = Counter()
    for t, (i, j) in enumerate(x.schedule(own)):
        assert x.release(j, own[i], 1000) <= t < x.deadline(j, own[i], 1000) and j == had[i]
        had[i] += 1
        assert all(abs(had[s] - own[s] * (t + 1) / 1000) < 1 for s in range(len(own)))


def test_shares():
    assert x.shares([1, 1, 2], 8) == [2, 2, 4]
    assert sum(x.shares([1e-9, 1, 1], 10)) == 10 and min(x.shares([1e-9, 1, 1], 10)) == 1
    with pytest.raises(ValueError):
        x.shares([0.0, 1.0], 10)


def frame(spark, n=1500):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["a", "a", "b", "c", None]), f"s{i}") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string, _slot string")


def test_rows(spark):
    df = frame(spark)
    got = x.schedule_rows(df, {"a": 0.2, "b": 0.5, None: 0.2, "other": 5.0}, block=4).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in df.collect())
    by = {}
    for r in got:
        by.setdefault(r.slot, []).append(r)
        assert r.release <= r.slot < r.deadline
    sizes = Counter(r.source for r in df.collect())
    had, over = Counter(), set()
    weight = {r.source: r.weight for r in got}
    assert weight == {"a": 0.182, "b": 0.454, "c": 0.182, None: 0.182}
    for slot, rows in sorted(by.items()):
        assert len({(r.source, r.block) for r in rows}) == 1 and sorted(r.place for r in rows) == list(range(len(rows)))
        s = rows[0].source
        assert rows[0].block == had[s]
        had[s] += 1
        if had[s] * 4 >= sizes[s]:
            over.add(s)
        if not over:
            assert slot + 1 == sum(had.values())
            assert all(abs(had[k] - weight[k] * (slot + 1)) < 1 for k in weight)
    assert over == set(sizes)


def test_order_and_columns(spark, tmp_path):
    df = frame(spark)
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = x.mixed_rows(df, {"a": 1, "b": 1, "c": 1, None: 1}, block=1)
    assert out.columns == df.columns
    rows = out.collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, df.collect()))
    head = Counter(r.source for r in rows[:400])
    assert all(abs(n - 100) <= 1 for n in head.values())
    assert x.mixed_rows(df.limit(0)).count() == 0 and x.schedule_rows(df.limit(0)).count() == 0


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    got = x.op7(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() == got.select("slot", "place").distinct().count()
    text = got._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def furthest(weights, blocks):
    """The largest deviation from the target weights, in blocks, while all sources last."""
    w = [x_ / sum(weights) for x_ in weights]
    had, most = [0] * len(w), 0.0
    for slot, i, _ in x.turns(x.cycle(weights, blocks), blocks):
        had[i] += 1
        most = max(most, *(abs(h - v * (slot + 1)) for h, v in zip(had, w, strict=True)))
        if had[i] == blocks[i]:
            return most


def test_deviation_from_the_target_over_long_schedules():
    for sizes in ([2_000_000, *[200_000] * 20], [10_000_000, 400, 300, 90]):
        weights = [n**0.5 for n in sizes]
        assert furthest(weights, [-(-n // 32) for n in sizes]) < 1 + x.DRIFT
    assert furthest([0.0007, 0.9993], [200, 280_000]) < 1 + x.DRIFT


def test_long_plans_and_tiny_weights(spark, monkeypatch):
    df = frame(spark)
    few = {(r.doc_id, r.slot, r.place, r.weight) for r in x.schedule_rows(df, {"a": 1e-9}, block=4).collect()}
    monkeypatch.setattr(x, "PLAN_ROWS", 50)
    rows = x.schedule_rows(df, {"a": 1e-9, "b": 1.0}, block=4).collect()
    assert len(rows) == df.count() == len({(r.slot, r.place) for r in rows}) and all(r.release <= r.slot < r.deadline for r in rows)
    assert {(r.doc_id, r.slot, r.place, r.weight) for r in x.schedule_rows(df, {"a": 1e-9}, block=4).collect()} == few


def test_rows_with_maps_and_clashing_names(spark):
    df = spark.sql("select id as doc_id, 's' || (id % 2) as source, cast(null as string) as text, map('k', id) as m, id as _key, id as _hash, id as _turn, id as block, id as slot, id as _of, id as _source, id as _all from range(70)")
    got = x.mixed_rows(x.written(df, "t"))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == list(range(70))
    assert [r.doc_id for r in x.schedule_rows(df).collect()] and x.schedule_rows(df).count() == 70
