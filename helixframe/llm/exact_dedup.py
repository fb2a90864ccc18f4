"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

1. Each text is cut where its own content says so: at the first sentence end or newline after MIN characters; where none
   comes before MAX, at the first blank or mark of punctuation in any script after MIN; and without any, after MAX. Equal
   texts have equal cuts, and a shared passage gives the same chunks soon after its start.
2. Chunks are deduplicated into a dictionary. A chunk's identifier is its 64-bit hash and length; an identifier is
   verified if all chunks under it have equal bytes, which the smallest and the largest of them tell. Each task sends an
   identifier's chunk once, however many documents hold it.
3. A document is then its recipe, the ordered list of identifiers, written once; texts aren't moved again. Where an
   identifier isn't verified, the recipes of the documents that hold it carry the chunk itself in its place, so two
   recipes are equal exactly if their texts are.
4. Recipes are grouped with partial aggregation, and the group's result goes back to its rows by a join that adaptive
   execution can split where one recipe has a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import gathered, keep_only, whole_text, written

MIN, MAX = 768, 8192


def chunks(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The text's chunks in order; their concatenation is the text. None for the empty text."""
    pattern = rf"(?s).{{{least},{most - 2}}}?(?:[.!?]\s|\n)|(?=.{{{most}}}).{{{least},{most - 1}}}?[\s\p{{P}}]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("hash"), F.octet_length(chunk).alias("bytes"))


def dictionary(source: DataFrame, parts: Column, _identifier=identifier) -> DataFrame:
    """(id, low, high): every identifier once, with the smallest and the largest chunk under it; equal if it is verified."""
    c = source.select(F.explode(parts).alias("chunk")).select(_identifier(F.col("chunk")).alias("id"), "chunk")
    return c.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN, most: int = MAX, _identifier=identifier) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_bytes, keep_row (the group's number).

    Of rows with identical texts the one with the largest id stays. A null text counts as empty. A null id is smaller
    than any other. Of repeated rows with the same id and text exactly one stays. Other columns of df aren't returned and
    may have any name. An empty table gives an empty result.
    """
    text = whole_text()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = chunks(text, least, most)
    recipes = written(
        source.select("doc_id", F.monotonically_increasing_id().alias("row"), F.transform(parts, _identifier).alias("recipe"), F.octet_length(text).alias("text_bytes"), F.sha2(text, 256).alias("text_sha256")),
        "recipes",
    )
    unverified = written(dictionary(source, parts, _identifier).where("low != high").select("id"), "unverified")
    if unverified.isEmpty():
        keyed = recipes.withColumn("spelled", F.lit(None).cast("array<string>"))
    else:  # hash collisions: the documents concerned spell such chunks out
        keyed = _spelled(source, recipes, unverified, parts, _identifier)
    groups = keyed.groupBy("recipe", "spelled").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    on = keyed["recipe"].eqNullSafe(groups["recipe"]) & keyed["spelled"].eqNullSafe(groups["spelled"])
    out = keyed.join(groups, on)
    return out.select(keyed["doc_id"], F.col("keep.doc_id").alias("keep_id"), "group_size", (keyed["row"] == F.col("keep.row")).alias("kept"), "text_sha256", "text_bytes", F.col("keep.row").alias("keep_row"))


def _spelled(source: DataFrame, recipes: DataFrame, unverified: DataFrame, parts: Column, _identifier) -> DataFrame:
    """recipes with spelled: for documents that hold unverified identifiers, every chunk under one of them, in order."""
    rows = source.select("doc_id", F.sha2(whole_text(), 256).alias("text_sha256"), F.posexplode(parts).alias("pos", "chunk"))
    hit = rows.withColumn("id", _identifier(F.col("chunk"))).join(unverified, "id", "left_semi")
    chunk = F.transform(F.array_sort(F.collect_set(F.struct("pos", "chunk"))), lambda x: x["chunk"])
    spelled = hit.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(chunk.alias("spelled"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    return written(gathered(recipes.join(spelled, on, "left").drop("_id", "_sha")), "spelled")


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose text another row keeps, with all its columns, whatever their names.

    Of rows that repeat both id and text one stays; only such rows are grouped with their texts.
    """
    groups = exact_groups(df, id_col, text_col).select("doc_id", F.col("text_sha256").alias("sha"), "keep_row")
    return keep_only(df, written(gathered(groups), "groups"), "keep_row", F.max, id_col, text_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
