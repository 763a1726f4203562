"""Find secrets in whole texts, and tell widely copied examples from credentials of one owner by how the corpus shares them.

Base patterns give spans of three kinds. The method adds candidates: long mixed strings that no base span covers. The
hash of every found value is counted over the corpus by the distinct repositories and owners it occurs in. A value that
many owners share is a copied example; one that stays with few owners looks live. Live-looking candidates become spans of
kind ``owned``; base spans always stay, and are counted as live or copied beside.

Here an owner is a document's source, and a repository is a source's part in one language (null is a name of its own).

Defined results: a null or empty text has no spans (``base_sha256`` is that of the empty string); equal rows and equal
ids are counted and returned each; an empty table gives no rows; other columns are not read. Positions are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.llm.files import stored

#: Kinds in order, their patterns, which group is the value, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Strings of any length from 20 on with capital and small letters and digits.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])(?=[0-9A-Z+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
#: A value that more owners or repositories share is a copied example.
OWNERS, REPOSITORIES = 2, 4


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of ``pattern`` from left to right: kind, start, end (code points, end exclusive) and value; short values are left out.

    The text between the matches comes from a split by the same pattern, so lengths add up to positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), whole.alias("whole"), values.alias("value"))
    steps = F.filter(steps, lambda s: s["whole"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + F.char_length(s["whole"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["spans"], F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), s["value"].alias("value")))).alias("spans"),
        )

    found = F.filter(F.aggregate(steps, start, step, lambda acc: acc["spans"]), lambda s: F.char_length(s["value"]) >= least)
    # Most texts have no match: they are told by one search, without the split.
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then by kind as listed."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(keyed)


def found_in(docs: DataFrame) -> DataFrame:
    """Each document's base spans and further candidates, in order; texts are left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[spans_of(text, *b) for b in BASE])
    rows = docs.select("doc_id", "source", "lang", in_order(base).alias("base"), spans_of(text, "owned", CANDIDATE, 0, 20).alias("more"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "source", "lang", "base", in_order(free).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a value: distinct owners and repositories that have it, and its occurrences.

    Counts are made per (value, owner, repository) before anything else is shuffled, so a value in a third of all
    documents is one row per task.
    """
    uses = found.select("source", "lang", F.explode(F.concat("base", "more")).alias("s")).select("source", "lang", F.sha2("s.value", 256).alias("value_hash"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))  # noqa: E731  null is a name of its own
    each = uses.groupBy("value_hash", name(F.col("source")).alias("owner"), name(F.col("lang")).alias("part")).agg(F.count("*").alias("uses"))
    per_owner = each.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return per_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses")
    )


def find_secrets(docs: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row per document: ``base`` and ``owned`` spans with values, and how many values look live or are copied examples."""
    found = stored(found_in(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    shared = ownership(found)
    live = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    # Values have any length, so only their hashes and places are shuffled.
    uses = found.select("row", F.posexplode(F.concat("base", "more")).alias("at", "s")).select("row", "at", F.sha2("s.value", 256).alias("value_hash"))
    judged = uses.join(shared.select("value_hash", live.alias("live")), "value_hash")
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "live"))).alias("judged"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
    )
    is_live = lambda s, i: F.get(F.col("judged"), F.size("base") + i)["live"]
    none = F.array().cast(found.schema["more"].dataType)
    return found.join(per_row, "row", "left").select(
        "doc_id", "base", F.coalesce(F.filter("more", is_live), none).alias("owned"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "owned"))).alias("spans"), "n_live", "n_copied",
    )
