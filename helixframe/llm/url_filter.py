"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Features are DataFrame expressions on the url alone, the same for training and prediction: lengths, depth, digit ratio,
entropies, parameter counts, and statistics of the host's suffix learnt from the labelled urls. The trees are fitted on
the driver to a bounded sample of different labelled urls and applied in Arrow batches. held_out() tells how they do on
hosts that no label is known of.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import small_batches, tidy

#: Bound of what is fitted on: different labelled urls of each class.
SAMPLE = 10_000
#: Urls of a class that are gathered, by the estimate of how many there are, for each that is drawn.
SPARE = 4
TREES, DEPTH, RATE, RIDGE, BINS = 60, 3, 0.2, 1.0, 64
#: (verdict, host, path) rules of the production filter.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words in hosts that label a url as unwanted where no labels are given. Fixed values.
SEEDS = ("adult", "casino", "loan", "lottery", "pills", "poker", "porn", "spam", "viagra", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "longest_label", "host_hyphens", "host_digits", "digit_ratio", "host_entropy", "path_entropy", "parameters", "escapes", "other_letters")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): what follows the first '://' up to '/', '?', '#' or the end, with A-Z lowered; then up to '?', '#'
    or the end; then the rest. All empty for null or where there is no '://'."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    part = lambda i: F.regexp_extract(after, r"(?s)\A([^/?#]*)([^?#]*)(.*)\z", i)
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule whose host is the host or a parent domain of it and whose
    path begins the path; null if none fits. Of equally long rules the one named first wins."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    pick = lambda value: F.coalesce(*(F.when(f, F.lit(value(r))) for f, r in zip(fits, order, strict=True)))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def _entropy(s: Column) -> Column:
    """Bits per character."""
    n = F.length(s)
    p = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda acc, x: acc - x * F.log2(x))).otherwise(F.lit(0.0))


def features(url: Column, host: Column, path: Column, rest: Column) -> list[Column]:
    """Doubles in the order of FEATURES; a null url counts as empty."""
    u = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    digits = _count(u, "[0-9]")
    made = [
        F.length(u), F.length(host), F.length(path), F.length(rest), _count(path, "/[^/]"), F.size(labels), F.array_max(F.transform(labels, lambda x: F.length(x))), _count(host, "-"), _count(host, "[0-9]"),
        digits / F.greatest(F.length(u), F.lit(1)), _entropy(host), _entropy(F.translate(path, "0123456789", "0000000000")), _count(rest, "[?&][^&#=]*="), _count(u, "%[0-9A-Fa-f]{2}"), _count(u, "[^\\x00-\\x7F]"),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(FEATURES, made, strict=True)]


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


@dataclass
class Trees:
    """base and a list of trees; a tree's node is (feature, threshold, left, right, value), left -1 for a leaf."""

    base: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    unseen: tuple[float, float] = (0.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            f, t, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(DEPTH):
                inner = left[at] >= 0
                go = x[np.arange(len(x)), f[at]] <= t[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out

    def stats(self, names: list[str]) -> np.ndarray:
        return np.array([self.suffixes.get(s, self.unseen) for s in names]).reshape(-1, 2)


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, int, int, float]]:
    nodes: list[tuple[int, float, int, int, float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append((0, 0.0, -1, -1, float(-RATE * g[rows].sum() / (h[rows].sum() + RIDGE))))
        if depth == DEPTH or len(rows) < 2:
            return me
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, 0, 0)
        for f in range(binned.shape[1]):
            if not len(cuts[f]):
                continue
            b = binned[rows, f]
            lg = np.cumsum(np.bincount(b, g[rows], len(cuts[f]) + 1))[:-1]
            lh = np.cumsum(np.bincount(b, h[rows], len(cuts[f]) + 1))[:-1]
            gain = lg**2 / (lh + RIDGE) + (total_g - lg) ** 2 / (total_h - lh + RIDGE) - total_g**2 / (total_h + RIDGE)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
        if best[0] > 1e-6:
            _, f, i = best
            low = binned[rows, f] <= i
            left, right = split(rows[low], depth + 1), split(rows[~low], depth + 1)
            nodes[me] = (f, float(cuts[f][i]), left, right, 0.0)
        return me

    split(np.arange(len(g)), 0)
    return nodes


def fit_rows(x: np.ndarray, names: list[str], y: np.ndarray) -> Trees:
    """Boosted trees for logistic loss, classes weighted alike up to tenfold. One class gives that verdict, none allows."""
    model = Trees()
    seen: dict[str, list[int]] = {}
    for n, label in zip(names, y, strict=True):
        c = seen.setdefault(n, [0, 0])
        c[0] += 1
        c[1] += int(label)
    rate = (y.sum() + 1) / (len(y) + 2)
    model.unseen = (0.0, float(rate))
    for n, (k, bad) in sorted(seen.items()):
        model.suffixes[n] = (float(np.log1p(k)), float((bad + 10 * rate) / (k + 10)))
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        model.base = 10.0 if len(y) and y[0] else -10.0
        return model
    x = np.concatenate([x, model.stats(names)], 1)
    cuts, binned = [], np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mid = (values[1:] + values[:-1]) / 2
        cuts.append(mid if len(mid) < BINS else np.unique(mid[np.linspace(0, len(mid) - 1, BINS - 1).astype(int)]))
        binned[:, f] = np.searchsorted(cuts[f], x[:, f], "left")
    weight = np.where(y == 1, min(10.0, max(1.0, (y == 0).sum() / (y == 1).sum())), 1.0)
    p0 = float((weight * y).sum() / weight.sum())
    model.base = float(np.log(p0 / (1 - p0)))
    m = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        tree = _grow(binned, cuts, weight * (p - y), np.maximum(weight * p * (1 - p), 1e-12))
        model.trees.append(tree)
        m += Trees(0.0, [tree]).margin(x)
    return model


def drawn(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(url, label): at most so many different urls of each class, those with the lowest hashes. A url with both labels is
    unwanted. Each url counts once however many rows have it. Only about SPARE times the sample is shuffled."""
    known = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull())
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    # a url that has both labels must be seen under both, so unwanted ones are all looked at that wanted ones may be
    share = {k: min(1.0, SPARE * sample / max(x, 1)) for k, x in n.items()}
    share[1] = max(share.get(1, 1.0), share.get(0, 0.0))
    bound = F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share.get(0, 1.0)))
    each = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < bound * (1 << 30)).groupBy("url").agg(F.max("label").alias("label"))
    parts = [each.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(sample) for k in (0, 1)]
    return parts[0].unionAll(parts[1])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits to the drawn rows of url and label (1 unwanted, 0 wanted; others and nulls are left out)."""
    host, path, rest = split_url(F.col("url"))
    parts = drawn(labelled, sample).select("url", "label", host.alias("h"), path.alias("p"), rest.alias("r"))
    rows = parts.select("url", *features(F.col("url"), F.col("h"), F.col("p"), F.col("r")), suffix(F.col("h")).alias("suffix"), "label").collect()
    rows = sorted(rows, key=lambda r: r["url"])
    x = np.array([r[1 : 1 + len(FEATURES)] for r in rows], float).reshape(-1, len(FEATURES))
    return fit_rows(x, [r["suffix"] for r in rows], np.array([r["label"] for r in rows], np.int64))


def held_out(labelled: DataFrame, folds: int = 5, sample: int = SAMPLE) -> dict[str, float]:
    """How the trees do on hosts that they have seen nothing of: shares of labelled urls judged rightly, of unwanted ones
    blocked and of wanted ones allowed, each fold of hosts judged by trees fitted to the others. Nan where there are none."""
    host, _, _ = split_url(F.col("url"))
    known = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull()).withColumn("_fold", F.pmod(F.xxhash64(host), F.lit(folds)))
    right, n = {0: 0, 1: 0}, {0: 0, 1: 0}
    for k in range(folds):
        model = fit(known.where(F.col("_fold") != k), sample)
        judged = judge(known.where(F.col("_fold") == k), model, "label", "url", ())
        for r in judged.groupBy("page_id", "verdict").agg(F.count(F.lit(1)).alias("n")).collect():
            n[r["page_id"]] += r["n"]
            right[r["page_id"]] += r["n"] * (r["verdict"] == ("block" if r["page_id"] else "allow"))
    share = lambda a, b: a / b if b else float("nan")
    return {"right": share(sum(right.values()), sum(n.values())), "blocked": share(right[1], n[1]), "allowed": share(right[0], n[0])}


def seed_labels(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Weak labels where a table has none: 1 if the host has one of the SEEDS, else 0. Null urls count as wanted."""
    host, _, _ = split_url(F.col(url_col))
    hit = F.lit(False)
    for s in SEEDS:
        hit = hit | F.contains(F.col("h"), F.lit(s))
    return df.select(F.col(url_col).alias("url"), host.alias("h")).select("url", hit.cast("int").alias("label"))


def judge(df: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (the trees' probability that the url is unwanted).

    verdict is the rule's or else, by the trees, block from a half on. Null urls and those without '://' have an empty host
    and path and are judged by the trees. Urls of any length are judged whole, repeated rows each, and equal urls alike; an
    empty table gives an empty result. Other columns aren't returned and may have any name.
    """
    host, path, rest = split_url(F.col("_url"))
    split = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", "_url", host.alias("host"), path.alias("path"), rest.alias("_rest"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    made = features(F.col("_url"), F.col("host"), F.col("path"), F.col("_rest"))
    rows = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), suffix(F.col("host")).alias("_suffix"), *made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(6 + i)) for i in range(len(FEATURES))]) if b.num_rows else np.zeros((0, len(FEATURES)))
            p = 1 / (1 + np.exp(-np.clip(model.margin(np.concatenate([x, model.stats(b.column(5).to_pylist())], 1)), -30, 30)))
            verdicts = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(b.column(4).to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(verdicts, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kinds = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    return small_batches(rows).mapInArrow(tidy(run), T.StructType([T.StructField("page_id", rows.schema["page_id"].dataType), *kinds, T.StructField("score", T.DoubleType())]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, fit(seed_labels(pages)))
