"""Near-duplicates by SimHash, linked with the generalised pigeonhole principle.

1. Each whole text becomes a 64-bit fingerprint; equal fingerprints are one node from here on, however many rows have it.
2. Co-occurrence counts of all fingerprints' bits tell which bits are correlated; a greedy pass groups correlated bits
   into partitions, for a few numbers of partitions.
3. Two fingerprints within K bits are within t_i bits in some partition i if the t_i add up to K - partitions + 1, where
   -1 leaves a partition out. The number of candidates that a partition gives with threshold 0 is counted over all
   fingerprints, and estimated from it for larger ones; dynamic programming finds the thresholds, and their total the
   number of partitions, with the fewest candidates and probes.
4. Fingerprints are indexed by their values in each partition; probes are the values within its threshold. Candidates are
   verified by counting differing bits.
5. A value that more than BUCKET fingerprints share isn't paired. All fingerprints that are indexed under it or probe it
   are linked exactly and in linear time instead: each gives itself and its 64 neighbours at one bit as keys, and those
   with a common key, which are within two bits of each other, are linked to the smallest.
6. Links become components by alternating star operations, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import gathered, keep_only, made_so_far, settled, small_batches, tidy, written

BITS, K, WORDS, SEED = 64, 2, 3, 42
#: Fingerprints under one value that are paired; beyond it they are linked by neighbours.
BUCKET = 128
#: Numbers of partitions to choose from.
PARTITIONS = (2, 3, 4)
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer."""
    w = data.lower().split()  # of bytes: A-Z only, and only the six ASCII blanks
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    n, h = len(w) - words + 1, xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        hashes = np.fromiter((h(s, seed) for s in shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, sha, fp) per row: sha is the text's SHA-256 and fp the fingerprint's bits as a signed long. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "sha", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("sha", T.StringType()), T.StructField("fp", T.LongType())])
    return small_batches(source).mapInArrow(tidy(run), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are set together; a fixed number of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.asarray(b.column(0)).astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), BLOCK):
                c += bits[i : i + BLOCK].T @ bits[i : i + BLOCK]
            n += len(x)
        if n:
            flat = np.append(c.astype(np.int64).ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

    got = nodes.select("fp").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in got:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many groups of like size; each group grows by the bit most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = BITS // parts + (g < BITS % parts)
        start = max(left, key=lambda b: (related[b, sorted(left)].sum(), -b))
        own = [start]
        left.remove(start)
        while len(own) < size:
            best = max(left, key=lambda b: (related[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def estimates(n: int, equal_pairs: float, differ: np.ndarray, most: int) -> list[float]:
    """Candidates of a partition for thresholds 0 to most: what is counted for 0, scaled by how the number of differing
    bits of two fingerprints is distributed if its bits differ independently with these chances."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    at_most = np.cumsum(dist)
    base = max(equal_pairs, n * n / 2 * at_most[0])
    return [min(base * at_most[t] / max(at_most[0], 1e-300), n * n / 2) for t in range(most + 1)]


def allocate(costs: list[list[float]], k: int = K) -> tuple[float, list[int]]:
    """Thresholds, -1 to k, that add up to k - partitions + 1 at the least total cost; costs[i][t] is for t from 0."""
    want = k - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, k + 1):
                new = cost + (row[t] if t >= 0 else 0.0)
                if total + t not in step or new < step[total + t][0]:
                    step[total + t] = (new, [*chosen, t])
        best = step
    return best[want]


def flips(bits: list[int], t: int) -> list[int]:
    """Masks of at most t of the bits."""
    out, last = [0], [(0, -1)]
    for _ in range(t):
        last = [(m | 1 << b, i) for m, j in last for i, b in enumerate(bits) if i > j]
        out += [m for m, _ in last]
    return out


@dataclass
class Partitioning:
    groups: list[list[int]]
    thresholds: list[int]


def choose(nodes: DataFrame, k: int = K) -> Partitioning:
    """Partitions and thresholds for these fingerprints, from counts over all of them."""
    n, together = bit_counts(nodes)
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    options = {m: grouped_bits(n, together, m) for m in PARTITIONS}
    masks = [(m, i, _signed(sum(1 << b for b in g))) for m, groups in options.items() for i, g in enumerate(groups)]
    keys = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for j, (_, _, mask) in enumerate(masks)))).alias("x")
    sizes = nodes.select(keys).groupBy("x.j", "x.v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = {r["j"]: r["pairs"] for r in sizes.groupBy("j").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    found = []
    for m, groups in options.items():
        costs = []
        for i, g in enumerate(groups):
            j = next(j for j, x in enumerate(masks) if x[:2] == (m, i))
            e = estimates(n, pairs.get(j, 0.0), differ[g], k)
            costs.append([e[t] + n * len(flips(g, t)) for t in range(k + 1)])
        cost, thresholds = allocate(costs, k)
        found.append((cost, m, thresholds))
    _, m, thresholds = min(found)
    return Partitioning(options[m], thresholds)


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, how: Partitioning, k: int = K, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: pairs of fingerprints within k bits that connect all that such pairs connect."""
    if k > 2:
        raise ValueError("values shared by many are linked exactly only for up to two bits")
    own, probes = [], []
    for i, (g, t) in enumerate(zip(how.groups, how.thresholds, strict=True)):
        if t < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in g))))
        own.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
        probes += [F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(_signed(m))).alias("value")) for m in flips(g, t)]
    index = nodes.select("fp", F.explode(F.array(*own)).alias("x")).select(F.col("fp").alias("a"), "x.part", "x.value")
    probe = nodes.select("fp", F.explode(F.array(*probes)).alias("x")).select(F.col("fp").alias("b"), "x.part", "x.value")
    full = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).drop("n")
    full = written(gathered(full), "full")
    on = ["part", "value"]
    other = F.col("a") != F.col("b") if any(t > 0 for t in how.thresholds) else F.col("a") < F.col("b")
    near = index.join(full, on, "left_anti").join(probe, on).where(other & (_differ(F.col("a"), F.col("b")) <= k))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = probe.join(full, on, "left_semi").select(F.col("b").alias("fp")).distinct()
    key = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)))).alias("key")
    balls = many.select("fp", key)
    least = balls.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select(F.col("key").alias("_key"), "low")
    stars = balls.join(least, F.col("key") == F.col("_key")).where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return near.unionAll(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is its component's smallest node."""
    mark = made_so_far()
    now = written(gathered(edges.select("a", "b")), "links")
    for _ in range(most_rounds):
        ends = now.select(F.col("b").alias("node"), F.col("a").alias("parent")).unionAll(now.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("parent")))
        seen = ends.groupBy("node").agg(F.min("parent").alias("low"), F.max("parent").alias("high"), F.max(F.col("parent").isNull()).alias("is_parent"))
        if seen.where("low is not null and (is_parent or low != high)").isEmpty():
            break
        # large star: every larger neighbour goes to the smallest one
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("low").alias("a"), "b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("u"), "low")
        small = large.join(low, F.col("b") == F.col("u")).where("a != low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        now = settled(gathered(small.unionAll(low.select(F.col("low").alias("a"), F.col("u").alias("b"))).distinct()), "links", mark)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, sha, fp, root (the component's smallest fingerprint), component_id (its smallest
    doc_id). Texts without words have fingerprint zero and link like any other. Rows with a null id take part; a
    component of null ids only has a null component_id. An empty table gives an empty result."""
    rows = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = written(gathered(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))), "nodes")
    how = choose(nodes, k)
    root = components(links(nodes, how, k, bucket))
    placed = nodes.join(root, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    of = placed.join(least, F.col("root") == F.col("_root")).select("_fp", "root", "component_id")
    return rows.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "sha", "fp", "root", "component_id")


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, with all columns, that have their component's smallest id; one row of each component. A null id is
    smaller than any other here, though component_id, a report, passes over it."""
    groups = written(gathered(near_groups(df, id_col, text_col).select("doc_id", "sha", "root")), "components")
    return keep_only(df, groups, "root", F.min, id_col, text_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
