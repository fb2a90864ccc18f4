"""A training corpus from raw documents: language, exact and near duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which is a written table. All but the last return
the columns of docs. Language identification drops documents that have no language, that is null texts and texts without
a letter. Exact deduplication keeps the row with the largest id of each text, near-deduplication the one with the smallest
of each component. Components are op10's (3-word shingles, 2 of 64 bits), which catches few of the pairs at a Jaccard
similarity of 0.8 or more of five-word shingles: 1 of 48 at sf0.1; the others stay in the corpus. Mixing keeps all rows and orders them. Packing returns a row per piece with its sequence and offset; it packs the pieces of
WINDOW consecutive blocks of the mixture's schedule together, found from the rows and not from their order in files, so
sequence ids follow the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, langid, mixing, packing, simhash
from helixframe.llm.common import made_so_far, settled, written


#: Target weights of sources, None for the default, and blocks of the schedule whose pieces are packed together.
MIXTURE, WINDOW = None, 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't null and has a letter; the smallest id may be null, and repeated rows all stay. An empty table
    stays empty."""
    return langid.accepted_rows(docs, langid.default_vocabulary())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null texts count as empty, null ids as smallest, and of rows equal
    in both one stays. An empty table stays empty."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id stays, null as smallest of all; null texts count as empty, and texts
    without words are one component. An empty table stays empty."""
    return simhash.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture; a null source is one of its own. An empty table stays empty."""
    return mixing.mixed_rows(docs, MIXTURE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place; a null or empty text is one token. An empty table gives no rows."""
    source = mixing.keyed(docs).withColumn("_row", F.monotonically_increasing_id())
    made = written(packing.pieces(source, packing.default_tokenizer(), carry=("_row", "_key", "_hash")), "pieces")
    turn = mixing.turned(made.where("piece = 0").select("_row", "_key", "_hash"), MIXTURE)
    window = turn.select("_row", F.expr(f"_turn div {WINDOW}").alias("_window"))
    return packing.pack_windows(made.join(window, "_row").drop("_row", "_key", "_hash"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language models, fingerprints and tokens have no equivalent in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; each earlier stage is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made_so_far()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
