"""Packing token sequences by length patterns and non-negative least squares.

1. Tasks tokenize whole texts, cut documents longer than a sequence, and write one slim row per piece; texts don't move.
2. The histogram of piece lengths, at most one row per length, goes to the driver. Lengths are binned; patterns of up to
   PARTS bins that fill a sequence are enumerated; non-negative least squares fits how often each should repeat so that
   the patterns use up the histogram; repeats are rounded.
3. The plan is made exact on the histogram: a pattern's bins give lengths, its last place the best-fitting length, as
   long as that fills sequences to the last token. What is left over is packed best fit, longest first. Each step places as many equal sequences as it can, so the plan
   has at most about one step per length and pattern, whatever the number of pieces.
4. A piece's rank among those of its length, found without gathering them, says which step places it and where.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import free_name, gathered, give_back, ranked, small_batches, tidy, written

CAPACITY = 2048
#: Token that ends each document.
END = 0
#: Lengths in one bin of the fit, and bins in one pattern.
BIN, PARTS = 32, 4
#: Letters that stay single composed letters in lower case, and ASCII punctuation without the apostrophe, which may begin
#: a piece of its own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ɏА-яёЁ"
_MARKS = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
#: Bytes of text that are tokenized together.
BLOCK = 2 << 20
#: Runs of letters whose ids a worker holds between blocks, and bytes of a word whose run may be held. Others are encoded
#: again when they come.
HELD, HELD_BYTES = 1 << 17, 64
#: The plan is broadcast up to so many rows; a longer one is joined by shuffling.
PLAN_ROWS = 65_536


class WordTokenizer:
    """The tokenizer's ids for whole texts, by way of ids of their distinct words.

    Only for a tokenizer whose pieces never cross a blank, a newline, or the border of letters and punctuation, that drops
    blanks and newlines, and marks the last token of each run. A text's ids are then its words' ids in order, and a word of
    letters with punctuation after it has the letters' ids and the punctuation's. Splitting a text into runs is most of the
    tokenizer's work; Arrow does it here, and finds the distinct runs in lower case, so the model gets each run of letters
    of a block once and as it is, and none that is held from earlier blocks. Words of any other form, and very long ones,
    go through the whole tokenizer. Which runs are held never changes the ids: of more than HELD the rarest of late go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tok, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        bare.normalizer, bare.pre_tokenizer = None, ByteLevel(add_prefix_space=False, use_regex=False)
        self.encode, self.encode_runs = tok.encode_batch_fast, bare.encode_batch_fast
        self.last = np.zeros(tok.get_vocab_size(), bool)
        self.last[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.known, self.known_ids, self.use = pa.array([], pa.string()), pa.array([], pa.large_list(pa.uint32())), np.zeros(0, "f4")

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of words through the whole tokenizer, and how many each has."""
        found = [e.ids for i in range(0, len(words), 4096) for e in self.encode(words[i : i + 4096], add_special_tokens=False)]
        return [np.fromiter((i for ids in found for i in ids), "<u4")], list(map(len, found))

    def _runs(self, runs: pa.Array) -> pa.LargeListArray:
        """Ids of distinct runs of letters in lower case, each of which has one marked token, its last."""
        found = pc.index_in(runs, value_set=self.known)
        fresh = np.asarray(found.is_null())
        new, flat, sizes = runs.filter(pa.array(fresh)), [np.zeros(0, "<u4")], [0]
        words = new.to_pylist()
        for i in range(0, len(words), 8192):
            ids = np.asarray(self.encode_runs([words[i : i + 8192]], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            flat.append(ids)
            sizes += np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0).tolist()
        made = pa.LargeListArray.from_arrays(np.cumsum(sizes), np.concatenate(flat))
        at = np.array(found.fill_null(0), np.int64)
        at[fresh] = len(self.known) + np.arange(len(new))
        known, known_ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.known_ids, made])
        use = np.concatenate([self.use * np.float32(0.9), np.zeros(len(new), "f4")])
        use[at] += 1
        out = known_ids.take(pa.array(at))
        if len(known) > HELD:
            stay = np.argpartition(use, -HELD)[-HELD:]
            known, known_ids, use = known.take(pa.array(stay)), known_ids.take(pa.array(stay)), use[stay]
        self.known, self.known_ids, self.use = known, known_ids, use
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return b"".join(self.all_ids(pa.array(cut(text), pa.string())))

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a block."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        form = pc.extract_regex(words, f"^(?P<run>[{_LETTERS}]+)(?P<tail>[{_MARKS}]*)$")
        simple = np.asarray(form.is_valid()) & (np.asarray(pc.binary_length(words)) <= HELD_BYTES)
        run, tail = (form.field(i).filter(pa.array(simple)) for i in (0, 1))
        runs, tails = pc.utf8_lower(run).dictionary_encode(), tail.dictionary_encode()
        rest = words.filter(pa.array(~simple)).to_pylist() + tails.dictionary.to_pylist()
        known = self._runs(runs.dictionary)
        more, others = self._words(rest)
        # each distinct word is two of the parts: its run and tail, or the word itself and nothing
        size = np.concatenate([np.diff(np.asarray(known.offsets)), others, [0]]).astype(np.int64)
        parts = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), np.concatenate([np.asarray(known.flatten()), *more]))
        two = np.full((len(words), 2), len(size) - 1, np.int64)
        alone = len(rest) - len(tails.dictionary)
        two[simple, 0] = np.asarray(runs.indices)
        two[simple, 1] = len(known) + alone + np.asarray(tails.indices)
        two[~simple, 0] = len(known) + np.arange(alone)
        length = size[two].sum(1)
        each = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]), parts.take(pa.array(two.ravel())).flatten())
        data = np.asarray(each.take(coded.indices).flatten()).tobytes()
        at = np.concatenate([[0], np.cumsum(length[np.asarray(coded.indices)])])
        ends = 4 * at[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def cut(text: str, size: int | None = None) -> list[str]:
    """The text in pieces of about that size that end before a blank."""
    size, out, at = size or BLOCK, [], 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


_held: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process and path."""
    if path not in _held:
        _held[path] = WordTokenizer(path)
    return _held[path]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked) for each row: its text's ids and END, cut at capacity.

    A null or empty text is the one token END. A text of any length is tokenized whole. Repeated rows are pieces each; an
    empty table gives an empty result. Of other columns those in carry are returned, last; the rest may have any name.
    """
    size = 4 * capacity
    end = np.asarray([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(tokenizer)
        def tokenized(texts: pa.Array) -> Iterator[bytes]:
            sizes = np.asarray(pc.binary_length(texts))
            first = total = 0
            for i, n in enumerate(sizes.tolist()):
                if n > BLOCK or total + n > BLOCK:
                    if first < i:
                        yield from tok.all_ids(texts.slice(first, i - first))
                    first, total = i, 0
                if n > BLOCK:
                    yield b"".join(tok.all_ids(pa.array([part]))[0] for part in cut(texts[i].as_py()))
                    first = i + 1
                else:
                    total += n
            if first < len(texts):
                yield from tok.all_ids(texts.slice(first))

        for b in batches:
            rows: list[tuple] = []
            held = 0
            for i, ids in enumerate(tokenized(b.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                held += len(ids)
                if held > 16 << 20 or i + 1 == b.num_rows:
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                    arrays = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        flat = pa.array(np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32))
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cols[3]]), pa.int32()), flat))
                        names.append("ids")
                    arrays += [b.column(2 + k).take(pa.array(cols[0], pa.int64())) for k in range(len(carry))]
                    names += carry
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    rows, held = [], 0

    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return small_batches(source).mapInArrow(tidy(run), T.StructType([*schema, *(source.schema[c] for c in carry)]))


def patterns(bins: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All descending tuples of at most so many bins that add up to all of them."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < parts:
            room = parts - len(head)
            for x in range(min(most, left), -(-left // room) - 1, -1):
                grow((*head, x), left - x, x)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """The x >= 0 that minimises |ax - b|: the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol * scale or passive.sum() >= m:
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                x = s
                break
            down = passive & (s <= 0)
            step = np.min(x[down] / np.maximum(x[down] - s[down], 1e-300))
            x = x + step * (s - x)
            gone = passive & (x <= 1e-12 * max(1.0, x.max()))
            if not (gone & down).any():
                gone |= down & (x == x[down].min())
            passive &= ~gone
            x[~passive] = 0
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which together use up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    width = max(1, min(width, capacity))
    bins = -(-capacity // width)
    found: list[tuple[tuple[int, ...], int]] = []

    def fitting(room: int) -> int:
        """The longest length at hand that fits, or 0."""
        at = np.flatnonzero(left[: room + 1])
        return int(at[-1]) if len(at) else 0

    def place(head: list[int], most: int, full: bool = False) -> int:
        """Takes the lengths in head, fills up best fit, and repeats that as often as the lengths last.

        With full, a sequence that doesn't fill up is undone and 0 returned.
        """
        for x in head:
            left[x] -= 1
        taken = list(head)
        while x := fitting(capacity - sum(taken)):
            left[x] -= 1
            taken.append(x)
        lengths, times = np.unique(taken, return_counts=True)
        if full and sum(taken) < capacity:
            left[lengths] += times
            return 0
        more = int(min((left[lengths] // times).min(), most - 1))
        left[lengths] -= more * times
        found.append((tuple(sorted(taken, reverse=True)), more + 1))
        return more + 1

    if left.any():
        coarse = np.zeros(bins)
        np.add.at(coarse, (np.arange(1, capacity + 1) + width - 1) // width - 1, left[1:])
        shapes = patterns(bins)
        a = np.zeros((bins, len(shapes)))
        for j, p in enumerate(shapes):
            for x in p:
                a[x - 1, j] += 1
        weight = np.where(np.arange(1, bins + 1) * 8 < bins, 0.1, 1.0)  # short pieces fill gaps anyway
        fit = nnls(a * weight[:, None], coarse * weight)
        for j in sorted(np.flatnonzero(fit >= 0.5), key=lambda j: shapes[j], reverse=True):
            repeats = round(float(fit[j]))
            while repeats > 0:
                head: list[int] = []
                for x in shapes[j][:-1] or shapes[j]:
                    at = np.flatnonzero(left[(x - 1) * width + 1 : min(x * width, capacity) + 1])
                    own = [int(i) + (x - 1) * width + 1 for i in at[::-1]]
                    own = next((i for i in own if left[i] > head.count(i)), 0)
                    if not own or sum(head) + own > capacity:
                        head = []
                        break
                    head.append(own)
                if not head or not (n := place(head, repeats, full=True)):
                    break
                repeats -= n
        while x := fitting(capacity):
            place([x], int(left[x]))
    return found


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (with length from 1 to capacity). Repeated rows are pieces
    of their own. An empty table stays empty. Other columns stay; where one has a name of an added column, in any case of
    letters, the added one gets underscores at its end."""
    spark = made.sparkSession
    sequence_id, at = free_name(made, "sequence_id"), free_name(made, "offset")
    length, first, end, shift, rank = (free_name(made, x) for x in ("_length", "_from", "_to", "_shift", "_rank"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = dict.fromkeys(histogram, 0)
    steps, base = [], 0
    for lengths, n in plan(histogram, capacity):
        offset = 0
        for x in lengths:
            steps.append((x, used[x], used[x] + n, base - used[x], offset))
            used[x] += n
            offset += x
        base += n
    table = spark.createDataFrame(steps, f"`{length}` long, `{first}` long, `{end}` long, `{shift}` long, `{at}` long")
    if len(steps) <= PLAN_ROWS:
        table = F.broadcast(table)
    r = ranked(made, ["length"], ["doc_id", "piece", "ids_crc32"], sum(histogram.values()), rank)
    on = (F.col("length") == F.col(length)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(end))
    return r.join(table, on).withColumn(sequence_id, F.col(rank) + F.col(shift)).select(*made.columns, sequence_id, at)


def pack_windows(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """As pack, for a table with _window, a long: each window's pieces are packed by themselves, in one task, and windows'
    sequences follow each other in the order of windows. Within a window sequences are in a fixed shuffle, so that lengths
    don't order them. A window must fit in a task."""
    columns = [c for c in made.columns if c != "_window"]

    def placed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "piece")])
        lengths, first, times = np.unique(np.asarray(table["length"]), return_index=True, return_counts=True)
        at = dict(zip(lengths.tolist(), first.tolist(), strict=True))
        sequence, offsets, base = np.empty(len(table), np.int64), np.empty(len(table), np.int64), 0
        for parts, n in plan(dict(zip(lengths.tolist(), times.tolist(), strict=True)), capacity):
            offset = 0
            for x in parts:
                sequence[at[x] : at[x] + n], offsets[at[x] : at[x] + n] = np.arange(base, base + n), offset
                at[x] += n
                offset += x
            base += n
        sequence = np.random.default_rng(0).permutation(base)[sequence]
        give_back()
        return table.append_column("_sequence", pa.array(sequence)).append_column("offset", pa.array(offsets))

    schema = T.StructType([*made.schema, T.StructField("_sequence", T.LongType()), T.StructField("offset", T.LongType())])
    done = written(gathered(made.groupBy("_window").applyInArrow(placed, schema)), "packed")
    sizes = {r["_window"]: r["n"] for r in done.groupBy("_window").agg((F.max("_sequence") + 1).alias("n")).collect()}
    order = sorted(sizes)
    starts = np.cumsum([0, *(sizes[w] for w in order)]).tolist()
    table = made.sparkSession.createDataFrame(list(zip(order, starts, strict=False)), "_of long, _start long")
    r = done.join(F.broadcast(table) if len(order) <= PLAN_ROWS else table, F.col("_window") == F.col("_of"))
    return r.withColumn("sequence_id", F.col("_start") + F.col("_sequence")).select(*columns, "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents with their places, under the public word vocabulary unless another path is given."""
    return pack(written(pieces(docs, tokenizer or default_tokenizer()), "pieces"))
