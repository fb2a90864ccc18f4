import itertools
import math
import random

import numpy as np
import pytest

from helixframe.llm import langid as x


def brute(unit, p):
    """The sum over all segmentations, one by one."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        parts, now = [], unit[0]
        for c, ch in zip(cuts, unit[1:], strict=True):
            if c:
                parts.append(now)
                now = ch
            else:
                now += ch
        parts.append(now)
        single = lambda s: p["?"] if len(s) == 1 else 0
        total += math.prod(p.get(s, single(s)) for s in parts)
    return total


def test_forward_is_the_sum_of_all_segmentations():
    rng = random.Random(1)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c", "bc", "é"]
    p = np.array([[rng.random() / 5 for _ in range(2)] for _ in range(len(pieces) + 1)])
    automaton, lengths = x._automaton(pieces)
    words = ["▁" + "".join(rng.choice("abcéz") for _ in range(rng.randrange(0, 8))) for _ in range(50)]
    got = x.Lattice(words, automaton, lengths).scores(p)
    for i in range(2):
        table = dict(zip([*pieces, "?"], p[:, i], strict=True))
        assert np.allclose(got[:, i], [math.log(brute(w, table)) for w in words])


def test_fit_likelihood_grows():
    counts = [("aa", "abab", 5), ("aa", "ab", 3), ("bb", "baba", 5), ("bb", "bz", 2)]
    pieces = ["▁", "▁a", "▁b", "a", "b", "ab", "ba"]
    automaton, lengths = x._automaton(pieces)
    lattice = x.Lattice(["▁abab"], automaton, lengths)
    scores = [lattice.scores(x.fit_counts(counts, pieces, rounds=r, smooth=1e-6).p)[0, 0] for r in (1, 2, 4, 8)]
    assert scores == sorted(scores)


MODEL = x.fit_counts([("en", w, 9) for w in ["the", "and", "with", "of", "that"]] + [("de", w, 9) for w in ["der", "und", "mit", "von", "über"]], ["▁", "th", "▁the", "▁und", "er", "an", *"abcdefghijklmnopqrstuvwxyzü"])


def test_predictions():
    s = x.Scorer(MODEL)
    got = s.predict(["the and THE", "Und der über", None, "", "12 ²½ ...", "with " * 2000, "z" * 5000])
    assert [g[0] for g in got[:6]] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= g[1] <= 1 for g in got) and got[2][1] == 0
    assert x.Scorer(x.fit_counts([], ["a"])).predict(["text"]) == [("und", 0.0)]


def test_blocks_and_cache(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abthernd") for _ in range(rng.randrange(1, 40))) for _ in range(60)) for _ in range(20)]
    want = x.Scorer(MODEL).predict(texts)
    for block, cache in ((50, 10), (300, 1), (10**6, 5)):
        monkeypatch.setattr(x, "BLOCK", block)
        monkeypatch.setattr(x, "CACHE", cache)
        got = x.Scorer(MODEL).predict(texts)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = x.op9(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 2), (3, "the and with", None, 3), (None, "über und der", "de", 4), (3, "the and with", None, 3), (5, "!?", "xx", 5)], "doc_id long, text string, lang string, _language int")
    got = x.accepted_rows(df, x.default_vocabulary())
    assert got.columns == df.columns
    assert sorted(r.text for r in got.collect()) == ["the and with", "the and with", "über und der"]
    assert x.accepted_rows(df.limit(0), x.default_vocabulary()).count() == 0


def test_rows_stay_where_nothing_can_be_learnt(spark):
    texts = ["the and with", "über", "пример", None, "", "12 ²½ ..."]
    unlabelled = [(i, t, None) for i, t in enumerate(texts)]
    held = [(i, t, "en") for i, t in zip((5, 7, 15, 17, 20, 22), texts, strict=True)]
    shared = [(i + 6 * k + 23, t, lang) for k, lang in enumerate(("en", "de")) for i, t in enumerate(texts[:1])]
    for rows in (unlabelled, held, shared):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = [r.text for r in x.accepted_rows(df, x.default_vocabulary()).collect()]
        assert sorted(got) == sorted(t for _, t, _ in rows if t in texts[:3])


def test_each_language_has_its_own_words(spark, monkeypatch):
    monkeypatch.setattr(x, "WORDS", 5)
    rows = [(i, " ".join(f"{lang}{c}" for c in "abcdefghijkl"), lang) for i, lang in enumerate(["de", "en", "th", "zh"])]
    model = x.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), x.default_vocabulary())
    assert model.languages == ["de", "en", "th", "zh"]


def test_languages_are_fitted_alike_alone_and_together():
    counts = [("aa", "abab", 5), ("aa", "ab", 3), ("bb", "baba", 5), ("bb", "bz", 2)]
    pieces = ["▁", "▁a", "▁b", "a", "b", "ab", "ba"]
    both = x.fit_counts(counts, pieces)
    for i, lang in enumerate(both.languages):
        assert np.allclose(both.p[:, [i]], x.fit_counts([c for c in counts if c[0] == lang], pieces).p)


def forward(unit, p, other):
    """The sum over all segmentations of one unit, position by position."""
    sums = [1.0] + [0.0] * len(unit)
    for end in range(1, len(unit) + 1):
        sums[end] = sum(sums[start] * p[unit[start:end]] for start in range(end) if unit[start:end] in p)
        if unit[end - 1] not in p:
            sums[end] += sums[end - 1] * other
    return sums[-1]


def test_predictions_by_hand(spark, monkeypatch):
    """Every prediction of a small table, from the model's probabilities, by plain loops."""
    monkeypatch.setattr(x, "CACHE", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 ²½ --", "de"), (9004, "x" * 60 + " " + "ñandú", None), (9005, "Ø Ý 漢字 слово", None), (9006, "Der, die; DAS", None), (9006, "Der, die; DAS", None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = x.fit(docs, x.default_vocabulary())
    tables = [dict(zip(model.pieces, model.p[:-1, i].tolist(), strict=True)) for i in range(len(model.languages))]
    other = model.p[-1].tolist()
    known = {}

    def word(w):
        if w not in known:
            known[w] = [sum(math.log(max(forward(u, t, o), 1e-300)) for u in x.units(w)) for t, o in zip(tables, other, strict=True)]
        return known[w]

    rows = docs.select("text", x.language(model, docs.text).alias("f")).select("text", "f.*").collect()
    assert len(rows) == docs.count() and len(model.languages) == 4
    for r in rows:
        words = x._WORD.findall((r.text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = [math.fsum(v) for v in zip(*map(word, words), strict=True)]
        best = max(total)
        assert total[model.languages.index(r.lang_pred)] == pytest.approx(best, abs=1e-6)
        assert r.score == pytest.approx(1 / sum(math.exp(t - best) for t in total), abs=1e-6)


def test_blocks_of_words_fit_alike(monkeypatch):
    rng = random.Random(6)
    counts = [(lang, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))), rng.randrange(1, 9)) for lang, letters in (("aa", "abc"), ("bb", "bcd")) for _ in range(200)]
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bc", "c", "cd", "bcd"]
    want = x.fit_counts(counts, pieces).p
    for words in (1, 7, 50):
        monkeypatch.setattr(x, "WORDS", words)
        assert np.allclose(x.fit_counts(counts, pieces).p, want)


def test_many_languages(spark, monkeypatch):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in df.where(x.held_out(df.doc_id)).collect()}
    assert x.fit(df, x.default_vocabulary()).languages == [lang for i, _, lang in rows if i not in held]
    monkeypatch.setattr(x, "LANGUAGES", 100)
    with pytest.raises(ValueError, match="languages"):
        x.fit(df, x.default_vocabulary())
