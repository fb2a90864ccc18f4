from collections import Counter

import corpus_pipeline
from helixframe.llm import langid, mixing
from tests.llm.test_packing import check
from tests.llm.test_simhash import roots, slow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Ids that stay after each of the first three stages."""
    keep = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    after = [set(keep)]
    last = {}
    for i, t in keep.items():
        last[t] = max(i, last.get(t, i))
    keep = {i: t for i, t in keep.items() if last[t] == i}
    after.append(set(keep))
    fp = {i: slow(t) for i, t in keep.items()}
    root, first = roots(set(fp.values())), {}
    for i in sorted(keep):
        first.setdefault(root[fp[i]], i)
    after.append(set(first.values()))
    return after


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10001, None, "en", "src0", 0), (10002, "", "en", None, 0), (10003, "12 34 ...", "de", "src1", 9), (10004, "short one", None, None, None)]
    docs.unionByName(spark.createDataFrame(odd, SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, now = brute(rows), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert now.columns == docs.columns
        if k < 3:
            assert Counter(r.doc_id for r in now.collect()) == Counter(want[k]), name
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    assert {r.doc_id for r in mixed.collect()} == want[2]
    texts = {i: t for i, t in rows if i in want[2]}
    assert check(now.collect(), texts, 2048) <= 1.05 * sum(r.length for r in now.collect()) / 2048 + 1
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in whole) == sorted(tuple(r)[:5] for r in now.collect())
    assert langid.UNDECIDED == "und" and mixing.BLOCK > 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sequences_follow_the_mixture(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    monkeypatch.setattr(corpus_pipeline, "WINDOW", 4, raising=False)
    favoured, found = sorted(set(source.values()))[:2], []
    for name in favoured:
        monkeypatch.setattr(corpus_pipeline, "MIXTURE", dict.fromkeys(source.values(), 1.0) | {name: 20.0}, raising=False)
        rows = corpus_pipeline.STAGES[4][1](spark, docs.orderBy("doc_id"), "").collect()
        mean = lambda ids: sum(ids) / len(ids)
        assert mean([r.sequence_id for r in rows if source[r.doc_id] == name]) < 0.6 * mean([r.sequence_id for r in rows])
        ids = {r.sequence_id for r in rows}
        assert ids == set(range(len(ids))) and len(ids) <= 1.05 * sum(r.length for r in rows) / 2048 + 1
        found.append(sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))
    assert found[0] == found[1]
