"""From documents to packed training sequences: each stage's decisions take effect on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_groups
from tessera.llm.mixing import WORD, mix, row_hash
from tessera.llm.near_dedup import near_groups
from tessera.llm.packing import pack, tokenizer_path
from tessera.llm.scratch import documents_of, materialize
from tessera.llm.skew import with_keys
from tessera.llm.toxicity import score_of, train


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Those names, lengthened until no column of docs begins like them."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return [prefix + n for n in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null texts are empty and stay, as empty ones do; rows that repeat are judged alike; long texts are scored whole; an
    empty table gives no rows; columns of any other name pass unchanged. Without labels nothing goes.
    """
    lexicon, weights = train(docs, documents_of(spark, sf_dir, "labels"))
    return docs.where(score_of("text", lexicon, weights) < 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the row with the largest doc_id stays; repeated rows become one.

    Null texts count as empty and equal each other; null ids lose to any other; texts of any length are compared whole;
    an empty table gives no rows; columns of any other name pass unchanged (of repeated rows, one row's).
    """
    key, sha, digest = fresh(docs, "key", "sha", "digest")
    groups = exact_groups(docs).where("group_size > 1")
    groups = groups.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    groups = materialize(groups, "groups")
    dropped, again = groups.where("not kept").select(key, sha), groups.where("kept and n > 1").select(key, sha)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(sha))
    keyed = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    out = with_keys(keyed, dropped, same, "left_anti")
    if not again.isEmpty():
        once = with_keys(keyed, again, same, "left_semi").dropDuplicates(["doc_id", digest])
        out = with_keys(out, again, same, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the smallest doc_id stays; rows without id stay.

    Null and empty texts are near to nothing and stay; of equal sets too the smallest id stays; rows of one id stay or
    go together; an empty table gives no rows; columns of any other name pass unchanged.
    """
    (key,) = fresh(docs, "key")
    dropped = materialize(near_groups(docs).where("not kept").select(F.col("doc_id").alias(key)).distinct(), "dropped")
    return with_keys(docs, dropped, F.col("doc_id") == F.col(key), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a copy taken in part holds its first words, joined by a space.

    Null, empty and wordless texts have size 0 and aren't taken; null is a source of its own, the last; of rows that
    repeat as many stay as the mix takes of all of them; ties of the hash order are broken by doc_id and size; an empty
    table gives no rows; columns of any other name pass unchanged (of repeated rows, one row's).
    """
    key, h, copies, part, n, row, copy = fresh(docs, "key", "h", "copies", "part", "n", "row", "copy")
    plan = mix(docs).groupBy(F.col("doc_id").alias(key), F.col("h").alias(h)).agg(F.sum("copies").alias(copies), F.max("part").alias(part), F.count("*").alias(n))
    plan = materialize(plan, "copies")
    keyed = docs.withColumn(row, row_hash("doc_id", "text"))
    if not plan.where(F.col(n) > 1).isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", row])
    rows = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(row) == F.col(h)))
    # 0 stands for a copy in part, others for whole ones
    times = F.concat(F.array_repeat(F.lit(1), F.col(copies).cast("int")), F.array_repeat(F.lit(0), (F.col(part) > 0).cast("int")))
    rows = rows.withColumn(copy, F.explode(times))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(part).cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col(copy) == 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(copy) == 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    Null and empty texts are their end id alone; long texts are cut into windows; rows that repeat are documents of
    their own; pieces of one place are equal rows, so ties don't matter; an empty table gives no rows; other columns end here.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL form: stages learn, sketch and tokenise. tests/llm checks the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
