"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, found by the forward algorithm; a text's is the product over its words. Probabilities are
fitted by expectation and maximisation over segmentations (forward and backward) on word counts of a bounded sample of
labelled documents. Words are runs of letters in lower case; longer ones are scored in units of UNIT characters.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import free_name, small_batches, tidy, written

#: Bounds of what is fitted on: labelled documents per language (expected); languages, more of which are an error.
SAMPLE, LANGUAGES = 300, 1000
#: Words of a language whose segmentations are in memory together; fitting goes over all words in such blocks.
WORDS = 60_000
ROUNDS, SMOOTH = 4, 0.05
UNIT = 24
#: Words whose scores a worker keeps in each of two generations, and characters of text whose new words are learnt together.
CACHE, BLOCK = 60_000, 1 << 20
UNDECIDED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


@dataclass
class Model:
    """Languages, pieces, and a probability for each piece and, last, for any other character: pieces + 1 by languages."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray


def vocabulary(path: str) -> list[str]:
    """The pieces of a public sentencepiece model that can occur in lower-case words; ▁ marks a word's start."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if p == p.lower() and (p == "▁" or re.fullmatch(r"▁?[^\W\d_]+", p))})


def units(word: str) -> list[str]:
    """The word, marked, in units of bounded length."""
    marked = "▁" + word
    return [marked] if len(marked) <= UNIT + 1 else [marked[i : i + UNIT] for i in range(0, len(marked), UNIT)]


class Lattice:
    """All pieces in each of many units, as arcs from a position to a later one of the units' joined text."""

    def __init__(self, words: list[str], automaton: ahocorasick.Automaton, lengths: np.ndarray):
        text = "\n".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        own = np.zeros(len(text) + 2, np.int64)
        own[self.begin[1:]] = 1
        own = np.cumsum(own)
        hits = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
        to, piece = hits[:, 0] + 1, hits[:, 1]
        single = np.zeros(len(text) + 2, bool)
        single[to[lengths[piece] == 1]] = True
        inside = np.ones(len(text) + 1, bool)
        inside[self.end[:-1] + 1] = False  # the separators
        inside[0] = False
        other = np.flatnonzero(inside & ~single[: len(text) + 1])
        self.to = np.concatenate([to, other])
        self.piece = np.concatenate([piece, np.full(len(other), len(lengths))])
        self.start = self.to - np.concatenate([lengths[piece], np.ones(len(other), np.int64)])
        self.word = own[self.start]
        self.size = len(text) + 2

    def _sums(self, p: np.ndarray, frm: np.ndarray, to: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
        """At each position the sum over all paths of arcs from a unit's first position; rank orders positions."""
        total = np.zeros((self.size, p.shape[1]))
        total[first] = 1
        order = np.lexsort((to, rank))
        cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            arcs = order[a:b]
            ends = to[arcs]
            at = np.flatnonzero(np.diff(ends, prepend=-1))
            total[ends[at]] = np.add.reduceat(total[frm[arcs]] * p[self.piece[arcs]], at, axis=0)
        return total

    def forward(self, p: np.ndarray) -> np.ndarray:
        return self._sums(p, self.start, self.to, self.to - self.begin[self.word], self.begin)

    def backward(self, p: np.ndarray) -> np.ndarray:
        return self._sums(p, self.to, self.start, self.end[self.word] - self.start, self.end)

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Log-probability of each unit in each language."""
        return np.log(np.maximum(self.forward(p)[self.end], 1e-300))


def _automaton(pieces: list[str]) -> tuple[ahocorasick.Automaton, np.ndarray]:
    a = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        a.add_word(p, i)
    a.make_automaton()
    return a, np.fromiter(map(len, pieces), np.int64, len(pieces))


def _fit_language(words: list[tuple[str, int]], automaton: ahocorasick.Automaton, lengths: np.ndarray, rounds: int, smooth: float) -> np.ndarray:
    """One language's probabilities, from (word, count); languages don't depend on each other."""
    tally: dict[str, int] = {}
    for word, n in words:
        for u in units(word):
            tally[u] = tally.get(u, 0) + n
    own, counts = list(tally), np.array(list(tally.values()), float)[:, None]
    del tally

    def blocks() -> Iterator[tuple[Lattice, np.ndarray]]:
        for i in range(0, len(own), WORDS):
            yield Lattice(own[i : i + WORDS], automaton, lengths), counts[i : i + WORDS]

    held = list(blocks()) if len(own) <= WORDS else None
    p = (0.02 ** (1 / np.maximum(np.append(lengths, 1), 1)) / len(lengths))[:, None]
    for _ in range(rounds):
        c = np.full((len(lengths) + 1, 1), smooth)
        for lattice, weight in held or blocks():
            a, b = lattice.forward(p), lattice.backward(p)
            share = weight / np.maximum(a[lattice.end], 1e-300)
            use = a[lattice.start] * p[lattice.piece] * b[lattice.to] * share[lattice.word]
            c += np.bincount(lattice.piece, use[:, 0], len(lengths) + 1)[:, None]
        p = c / c.sum(0)
        p[-1] = 1e-6  # a character outside the vocabulary tells little
    return p[:, 0]


def fit_words(words: Iterable[tuple[str, list[tuple[str, int]]]], pieces: list[str], rounds: int = ROUNDS, smooth: float = SMOOTH) -> Model:
    """A model from each language's (word, count), one language at a time; those without words aren't in it."""
    automaton, lengths = _automaton(pieces)
    found = {lang: _fit_language(own, automaton, lengths, rounds, smooth) for lang, own in words if own}
    languages = sorted(found)
    return Model(languages, pieces, np.stack([found[x] for x in languages], 1) if found else np.zeros((len(pieces) + 1, 0)))


def fit_counts(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS, smooth: float = SMOOTH) -> Model:
    """A model from (language, word, count). No counts give a model without languages."""
    by: dict[str, list[tuple[str, int]]] = {}
    for lang, word, n in counts:
        by.setdefault(lang, []).append((word, n))
    return fit_words(by.items(), pieces, rounds, smooth)


def eligible(id_col: str, text_col: str, lang_col: str) -> Column:
    return ~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on about so many documents per language, drawn by a hash of the id among those not held out.

    A line counts once however often the sample has it, and not at all if documents of several languages have it, so
    boilerplate and repeated passages don't pass for a language. All words of the drawn documents count, and every
    language that has one in a line of its own is in the model. More than LANGUAGES languages raise. Rows without a text or
    a lang tell nothing; an empty table gives a model without languages.
    """
    docs = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(eligible("doc_id", "text", "lang"))
    n = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(n) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not n:
        return fit_counts([], vocabulary(vocabulary_path))
    said = json.dumps([{"_of": x, "_share": min(1.0, sample / k)} for x, k in n.items()])
    shares = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(said), "array<struct<_of: string, _share: double>>")))
    drawn = docs.join(F.broadcast(shares), F.col("lang") == F.col("_of")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    # each line once, and none that documents of several languages share
    lines = drawn.select("lang", F.explode(F.split("text", "\n")).alias("text")).groupBy("text").agg(F.min("lang").alias("lang"), F.max("lang").alias("_other")).where("lang = _other")
    words = lines.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    # of a bounded sample, so few files do
    counts = written(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).coalesce(df.sparkSession.sparkContext.defaultParallelism), "words")

    # a language's words at a time
    rows = counts.select("lang", "word", "n").orderBy("lang", "word").toLocalIterator()
    by = ((lang, [(word, k) for _, word, k in own]) for lang, own in itertools.groupby(rows, lambda r: r[0]))
    return fit_words(by, vocabulary(vocabulary_path))


class Scorer:
    """Predictions of one worker; scores of words already seen are kept up to a bound."""

    def __init__(self, model: Model):
        self.model, (self.automaton, self.lengths) = model, _automaton(model.pieces)
        self.at: dict[str, int] = {}
        self._fresh()

    def _fresh(self) -> None:
        """Begins a generation; the one before is kept."""
        self.old_at, self.old_rows = self.at, self.rows if self.at else None
        self.at = {}
        self.rows, self.n = np.zeros((1 << 12, len(self.model.languages))), 0

    def _add(self, words: list[str], scores: np.ndarray) -> None:
        while self.n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n : self.n + len(words)] = scores
        self.at.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            split = [units(w) for w in part]
            got = Lattice([u for s in split for u in s], self.automaton, self.lengths).scores(self.model.p)
            firsts = np.cumsum([0, *map(len, split[:-1])])
            self._add(part, np.add.reduceat(got, firsts, axis=0))

    def _words(self, text: str) -> Iterator[list[str]]:
        """Words of blocks that end between words."""
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + BLOCK)
            end = gap.start() if gap else len(text)
            yield _WORD.findall(text[at:end].lower() if at or end < len(text) else text.lower())
            at = max(end, at + 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        chars = 0
        for t in texts:
            if len(t or "") > BLOCK:
                out += self._short(held)
                held, chars = [], 0
                out.append(self._long(t))
                continue
            held.append(_WORD.findall(t.lower()) if t else [])
            chars += len(t or "")
            if chars > BLOCK:
                out += self._short(held)
                held, chars = [], 0
        return out + self._short(held)

    def _sum(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)

    def _know(self, words: set[str]) -> None:
        if len(self.at) > CACHE:
            self._fresh()
        words = words - self.at.keys()
        again = list(words & self.old_at.keys())
        if again:
            self._add(again, self.old_rows[[self.old_at[w] for w in again]])
        self._learn(list(words.difference(again)))

    def _short(self, held: list[list[str]]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNDECIDED, 0.0)] * len(held)
        self._know({w for words in held for w in words})
        return [self._decide(self._sum(w), any(c.isalpha() for x in w for c in x)) for w in held]

    def _long(self, text: str) -> tuple[str, float]:
        if not self.model.languages:
            return UNDECIDED, 0.0
        total, letters = np.zeros(len(self.model.languages)), False
        for words in self._words(text):
            self._know(set(words))
            total += self._sum(words)
            letters = letters or any(c.isalpha() for x in words for c in x)
        return self._decide(total, letters)

    def _decide(self, total: np.ndarray, letters: bool) -> tuple[str, float]:
        if not letters:
            return UNDECIDED, 0.0
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def language(model: Model, text: Column) -> Column:
    """struct(lang_pred, score) of a text: the likeliest language and its posterior under equal priors. A text that is
    null or has no letter is und with score 0; ties go to the first language by name. A text of any length is scored whole,
    equal texts alike; an empty table gives an empty result."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for s in batches:
            yield pd.DataFrame(scorer.predict([None if t is None or t != t else t for t in s.tolist()]), columns=["lang_pred", "score"])

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(scored)(batches)

    return predict(text)


def accepted_rows(df: DataFrame, vocabulary_path: str) -> DataFrame:
    """df's rows, with all columns, whose text isn't null and has a letter. Where nothing can be learnt, as when no row has
    a lang, these rows stay all the same."""
    model = fit(df, vocabulary_path)
    if not model.languages:
        return df.where(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    name = free_name(df, "_language")
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(name, language(model, F.col("text"))).where(F.col(f"{name}.lang_pred") != UNDECIDED).select(*own)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", language(fit(docs, default_vocabulary()), F.col("text")).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")
