"""Secret scans with multipart credential linking, in DataFrame functions only.

1. Patterns find parts in each whole text: values assigned to secret names, access identifiers and long hex runs, which
   are always reported, and weak candidates: logins, endpoints and unnamed base64 keys. A cheap test for a character or
   word that a pattern needs comes before the pattern. Only the lengths of matches and of the gaps between them leave this
   step; their running sums give offsets.
2. A scope is a paragraph, and in it a reach of REACH characters. An interval join by scope and bucket of REACH characters
   finds identifiers, secrets and endpoints whose starts are within reach of each other. A weak candidate is reported only
   if a complementary part is in reach: a login with a secret of any kind, a base64 key with an identifier, an endpoint
   with an identifier or a named secret (not a hex run alone, as links don't join these two either).

A bucket holds few parts, as parts don't overlap much, so the join grows with the text and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import base_of, count_kind, gathered, joined, written

#: Fixed order of kinds at equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "login", "endpoint", "key")
REACH = 400
#: Least length of an assigned secret.
LEAST = 12
_IS = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed patterns, in the order of the kinds.
PATTERNS = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){_IS}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "login": rf"(?i:user_?name|user|login|client_?id|account_?id){_IS}[A-Za-z0-9._@+-]{{3,64}}",
    "endpoint": r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@-]+(?:/[A-Za-z0-9._/-]*)?",
    "key": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
}
#: Which kinds may report a weak one.
PARTNERS = {"login": ("assign", "hex", "key"), "endpoint": ("access", "login", "assign"), "key": ("access", "login")}
_FOUND = "array<struct<kind: int, gap: int, blanks: int, size: int, good: boolean>>"


def _found(text: Column, kind: str, worth: Column) -> Column:
    """For each match: the gap before it, blank lines in the gap, its length, and whether it counts."""
    pattern = F.lit(PATTERNS[kind])

    def one(gap: Column, m: Column) -> Column:
        blanks = (F.length(gap) - F.length(F.replace(gap, F.lit("\n\n"), F.lit("")))) / 2
        good = F.length(F.regexp_extract(m, PATTERNS["assign"], 1)) >= LEAST if kind == "assign" else F.lit(True)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(gap).alias("gap"), blanks.cast("int").alias("blanks"), F.length(m).alias("size"), good.alias("good"))

    # both arrays are made once for a text; inside a lambda they would be made again for each match
    each = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)), one)
    found = F.filter(each, lambda x: x["size"].isNotNull())  # the last gap has no match after it
    return F.when(worth & F.regexp_like(text, pattern), found).otherwise(F.array().cast(_FOUND))


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, found): one written row per input row, whose row number stays as it is written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    t = F.col("text")
    names = F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))
    access = F.contains(t, F.lit("AKIA"))
    identified = access | (names & F.regexp_like(t, F.lit(PATTERNS["login"])))
    worth = {"assign": names, "access": access, "hex": F.lit(True), "login": names, "endpoint": F.contains(t, F.lit("://")), "key": identified}
    return written(base.select("doc_id", "row", F.concat(*(_found(t, k, worth[k]) for k in KINDS)).alias("found")), "found")


def parts(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, scope): all parts with offsets in code points; scope is the paragraph's number."""
    each = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("pos", "x")).select("row", "pos", "x.*")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("bigint")
    placed = each.select("row", "kind", "size", "good", end.alias("end"), F.sum("blanks").over(upto).cast("bigint").alias("scope"))
    return placed.where("good").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "scope")


def _near(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides by row, scope and bucket, the left in its own and the neighbouring buckets, and the join's condition."""
    bucket = F.floor(F.col("start") / F.lit(REACH)).cast("bigint")
    a = left.select("*", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), bucket.alias("r_bucket"))
    on = (F.col("row") == F.col("r_row")) & (F.col("scope") == F.col("r_scope")) & (F.col("bucket") == F.col("r_bucket")) & (F.abs(F.col("start") - F.col("r_start")) <= REACH)
    return a, b, on


def _of(kinds: tuple[str, ...], column: str = "kind") -> Column:
    return F.col(column).isin([KINDS.index(k) for k in kinds])


def credentials(found_parts: DataFrame) -> DataFrame:
    """(row, id_kind, id_start, secret_kind, secret_start, endpoint_start): identifiers and secrets in reach, with the
    first endpoint in reach of the identifier, or null."""
    a, b, on = _near(found_parts.where(_of(("access", "login"))), found_parts.where(_of(("assign", "hex", "key"))))
    pairs = a.join(b, on).select("row", "kind", "start", "scope", "r_kind", "r_start")
    a, b, on = _near(pairs, found_parts.where(_of(("endpoint",))).withColumnsRenamed({"kind": "e_kind", "end": "e_end"}))
    b = b.select("r_row", "r_scope", F.col("r_start").alias("e_start"), F.col("r_bucket").alias("e_bucket"))
    on = (F.col("row") == F.col("r_row")) & (F.col("scope") == F.col("r_scope")) & (F.col("bucket") == F.col("e_bucket")) & (F.abs(F.col("start") - F.col("e_start")) <= REACH)
    full = a.join(b, on, "left")
    return full.groupBy("row", F.col("kind").alias("id_kind"), F.col("start").alias("id_start"), F.col("r_kind").alias("secret_kind"), F.col("r_start").alias("secret_start")).agg(F.min("e_start").alias("endpoint_start"))


def reported(found_parts: DataFrame) -> DataFrame:
    """The parts to report: all of the base, and weak ones with a complementary part in reach."""
    base = found_parts.where(_of(KINDS[:3]))
    a, b, on = _near(found_parts.where(_of(tuple(PARTNERS))), found_parts)
    fits = F.lit(False)
    for weak, others in PARTNERS.items():
        fits = fits | (_of((weak,)) & _of(others, "r_kind"))
    weak = a.join(b, on & fits, "left_semi").select(*found_parts.columns).distinct()
    return base.unionByName(weak)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, credentials): one row per input row, repeated rows too; credentials counts linked pairs of an
    identifier and a secret. A null or empty text has no span; an empty table gives an empty result. Other columns aren't
    returned and may have any name."""
    found = scanned(df, id_col, text_col)
    p = written(gathered(parts(found)), "parts")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("rank"), name.alias("kind"), "end", (F.col("kind") < 3).alias("base"))
    spans = reported(p).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    linked = credentials(p).groupBy("row").agg(F.count(F.lit(1)).alias("credentials"))
    empty = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint, base: boolean>>")
    out = found.select("doc_id", "row").join(spans, "row", "left").join(linked, "row", "left")
    return out.select("doc_id", F.coalesce("spans", empty).alias("spans"), F.coalesce("credentials", F.lit(0)).cast("bigint").alias("credentials"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.col("spans")
    counts = [count_kind(spans, k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base_of(spans)), 256).alias("base_sha256"), joined(spans).alias("spans"), "credentials")
