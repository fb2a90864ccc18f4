"""What several operators share: the shared folder, written cuts of the lineage, ranks and span digests."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_made = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; a temporary folder only where none is set and the session runs
    on this machine alone, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        top = f"file://{tempfile.gettempdir()}/helixframe"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.paths = [*getattr(_made, "paths", []), path]
    return path


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def until_exit(spark: SparkSession, path: str) -> None:
    """The folder is removed when the driver ends, as a table made from it may be read until then."""
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


#: Files of a table written after a shuffle: so many for each core of the cluster, or one for so many bytes of the tables
#: that it is made from, whichever is more.
FILES_PER_CORE, FILE_BYTES = 4, 32 << 20


def gathered(df: DataFrame) -> DataFrame:
    """df, made by a shuffle, in at most so many partitions as its inputs' bytes call for, and so in no more files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    size = 0
    while leaves.hasNext():
        size += int(str(leaves.next().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, size // FILE_BYTES)))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what comes after reads it, and needs no lost executor's files. The
    table stays until the driver ends or settled() removes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_so_far() -> int:
    """A mark for settled()."""
    return len(getattr(_made, "paths", []))


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df as a table, as written() gives, with everything else removed that this thread wrote since the mark."""
    out = written(df, name)
    for path in _made.paths[since:-1]:
        discard(df.sparkSession, path)
    _made.paths = [*_made.paths[:since], _made.paths[-1]]
    return out


def whole_text(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows that one (key, bucket) of a ranking holds on average, at most.
RANK_ROWS = 20_000


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, out: str = "rank") -> DataFrame:
    """Adds a 0-based rank within keys, without bringing a key's rows into one task.

    Each key's rows fall into buckets by a hash of the order columns; a rank is the number of rows in the key's earlier
    buckets and the place in its own. The order within a key is therefore a fixed shuffle. df must be a table whose rows
    don't change between reads; rows is its size.
    """
    buckets = max(64, -(-rows // RANK_ROWS))
    columns, (part, own_, start, n) = df.columns, (free_name(df, x) for x in ("_part", "_own", "_start", "_n"))
    bucket, names = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"), [f"_k{i}" for i in range(len(keys))]
    # one struct, never null itself, for the window and the join alike: a null-safe join would shuffle df once more
    df = df.withColumn(part, F.struct(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True)), bucket.alias("_bucket")))
    before = Window.partitionBy(*(f"{part}.{x}" for x in names)).orderBy(f"{part}._bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(part).agg(F.count(F.lit(1)).alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    out_df = df.withColumn(own_, own).join(starts, part, "left")
    return out_df.select(*columns, (F.col(start) + F.col(own_)).cast("bigint").alias(out))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def joined(spans: Column) -> Column:
    """'kind:start:end,...' of an array of spans, which is sorted by start, then by the kinds' listed order."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


#: Keys of rows to drop that are broadcast at most, about 150 bytes each; more are joined by shuffling.
GONE_ROWS = 200_000


def keep_only(df: DataFrame, rows: DataFrame, group: str, best, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, with all its columns, cut to one row of each group.

    rows is a written table with a row per row of df: doc_id, sha (the SHA-256 of its text, null as empty) and the
    group; best is F.min or F.max of (doc_id, sha), where a null id is smaller than any other. Of rows that repeat both,
    the one stays whose values hash lowest; only such rows are grouped with their texts.
    """
    stays = rows.groupBy(group).agg(best(F.struct("doc_id", "sha")).alias("_best")).select(F.col("_best.doc_id").alias("_kid"), F.col("_best.sha").alias("_ksha"), F.col(group).alias("_kgroup"))
    times = rows.groupBy("doc_id", "sha", group).agg(F.count(F.lit(1)).alias("_times"))
    held = times.join(stays, F.col("doc_id").eqNullSafe(F.col("_kid")) & (F.col("sha") == F.col("_ksha")) & F.col(group).eqNullSafe(F.col("_kgroup")), "left")
    gone = held.where("_ksha is null or _times > 1").select(F.col("doc_id").alias("_gid"), F.col("sha").alias("_gsha"), F.col("_ksha").isNotNull().alias("_one"))
    gone = written(gathered(gone), "gone")
    keyed = df.select(F.struct("*").alias("_all"), row_hash(df).alias("_hash"), F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"))
    on = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_sha") == F.col("_gsha"))
    few = gone.count() <= GONE_ROWS
    plain = keyed.join(F.broadcast(gone) if few else gone, on, "left_anti").select("_all.*")
    repeated = gone.where("_one")
    if repeated.isEmpty():
        return plain
    once = keyed.join(F.broadcast(repeated) if few else repeated, on, "left_semi").groupBy("_id", "_sha").agg(F.min_by("_all", "_hash").alias("_all")).select("_all.*")
    return plain.unionByName(once)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, whatever their types; maps, which can't be hashed, go by their text."""
    plain = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    return F.xxhash64(*(c if plain(f) else c.cast("string") for f in df.schema.fields for c in [F.col(f"`{f.name}`")]))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that df doesn't have in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded by bytes, since both the executor and its workers hold whole batches."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = re.fullmatch(r"([0-9]+)([bkmg]?)b?", (conf.get(key, None) or "").lower())
    if not now or not 0 < int(now[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def give_back() -> None:
    """Returns freed memory to the system. Workers wait for further tasks, and there can be several to each core."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which maps an iterator of batches to another, with its memory given back at the end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
