"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

A notice of n shingles (5 words, lower-cased) belongs to the class of windows of W = 2^(k+1) shingles, one every 2^k, with
2^(k-1) < n <= 2^k, so some window holds any occurrence whole. A window that holds 0.75 of a notice has a Jaccard
similarity of at least 0.17 to it, one that holds it all at least 0.25; with ``bands`` bands of one MinHash each it collides
with probability 1 - (1 - J)^bands, which for 64 bands is 0.99999 and above. Windows retrieved are verified by exact
containment of shingles.

The bands are the index: each keeps, for every notice, the shingle whose hash is least in that band. A window collides in
a band only if that shingle is its own least one too, so only windows that hold a least shingle of some band are hashed;
the others can't collide, and a notice's other shingles retrieve nothing. Notices are a bounded parameter and broadcast.
A licence whose text holds another's (BSD-3-Clause that of BSD-2-Clause) is reported with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES
from .scratch import documents_of

WORDS, BANDS = 5, 64


def notice_shingles(notices: list[tuple[str, str]]) -> list[tuple[int, str, int, list[str]]]:
    """(number, license, class k, distinct shingles joined by a space); notices of fewer than five words can't be given."""
    out = []
    for number, (license, text) in enumerate(notices):
        words = text.lower().split()
        if len(words) < WORDS:
            raise ValueError(f"a notice needs {WORDS} words: {text!r}")
        shingles = list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))
        out.append((number, license, (len(shingles) - 1).bit_length(), shingles))
    return out


def scan_licenses(df: DataFrame, notices: list[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS) -> DataFrame:
    """One row per document and licence found: doc_id, license, containment (the best window's share of a notice's shingles).

    Null, empty and short texts have no shingles and give no row; rows that share a doc_id are scanned each and merged; an
    empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(notice_shingles(notices), "notice int, license string, k int, shingles array<string>")
    table = table.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))

    def least(values):
        """The band and, of the shingle with the least hash in it, that hash and the shingle."""
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(values, lambda x: F.struct(F.xxhash64(x, j).alias("low"), x.alias("h")))).alias("m")))

    index = table.select("notice", "k", F.explode(least(F.col("hashes"))).alias("s")).select("notice", "k", F.col("s.band").alias("band"), "s.m.low", "s.m.h")
    known = index.select("k", "h").distinct().collect()  # bounded by notices and bands
    by_hash: dict[int, list[int]] = {}
    for r in known:
        by_hash.setdefault(r["h"], []).append(r["k"])

    def once(frame: DataFrame, keep: list[str], value, name: str) -> DataFrame:
        """Computes an array once per row: Spark would else put its expression into each element's lambda below."""
        return frame.select(*keep, F.explode(F.array(value)).alias(name))

    words = F.array_remove(F.split(F.lower(F.col(text_col)), "[ \\t-\\r]+"), "")
    docs = once(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_col), ["doc_id"], words, "w").where(F.size("w") >= WORDS)
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - (WORDS - 1)), lambda i: F.xxhash64(F.slice("w", i, WORDS)))
    hashed = once(docs, ["doc_id"], shingles, "h")
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(list(by_hash)), F.struct((i + 1).alias("i"), x.alias("x")))), lambda s: s.isNotNull())
    hits = once(hashed, ["doc_id", "h"], at, "at").where(F.size("at") > 0)
    classes = F.create_map(*(F.lit(x) for h, ks in by_hash.items() for x in (h, F.array(*map(F.lit, ks)))))

    def windows(hit):
        # the two windows of each class that hold this shingle
        def of_class(k):
            last = F.floor((hit["i"] - 1) / F.pow(F.lit(2), k)).cast("int")
            return F.array(F.struct(k.alias("k"), last.alias("n")), F.struct(k.alias("k"), (last - 1).alias("n")))

        return F.flatten(F.transform(F.element_at(classes, hit["x"]), of_class))

    found = hits.select("doc_id", "h", F.explode(F.array_distinct(F.flatten(F.transform("at", windows)))).alias("win"))
    step = F.pow(F.lit(2), F.col("win.k")).cast("int")
    first = F.greatest(F.col("win.n") * step + 1, F.lit(1))
    last = F.least(F.col("win.n") * step + 2 * step, F.size("h"))
    found = once(found.select("doc_id", "win.k", F.slice("h", first, last - first + 1).alias("s")), ["doc_id", "k"], F.col("s"), "own")

    def signature(values):
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(values, lambda x: F.xxhash64(x, j))).alias("low")))

    keys = index.groupBy(F.col("k").alias("nk"), "band", "low").agg(F.collect_set("notice").alias("notices"))  # bounded by the notices
    banded = found.select("doc_id", "k", "own", F.explode(signature(F.col("own"))).alias("s"))
    retrieved = banded.join(F.broadcast(keys), (F.col("k") == F.col("nk")) & (F.col("s.band") == F.col("band")) & (F.col("s.low") == F.col("low")))
    retrieved = retrieved.select("doc_id", "own", F.explode("notices").alias("notice"))
    checked = retrieved.join(F.broadcast(table.select(F.col("notice").alias("number"), "license", "hashes")), F.col("notice") == F.col("number"))
    share = F.size(F.array_intersect("hashes", "own")) / F.size("hashes")
    checked = checked.select("doc_id", "license", share.alias("containment")).where(F.col("containment") * 100 >= percent)
    return checked.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents_of(spark, sf_dir)).withColumn("containment", F.round("containment", 6))


def op9_sql() -> str:
    rows = ", ".join("({}, '{}', {}, '{}')".format(n, lic, k, s.replace("'", "''")) for n, lic, k, shingles in notice_shingles(NOTICES) for s in shingles)
    return f"""
WITH notice(number, license, k, shingle) AS (VALUES {rows}),
size AS (SELECT number, count(*) AS n FROM notice GROUP BY number),
word AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM word WHERE len(w) >= 5)),
hit AS (SELECT s.doc_id, s.i, n.* FROM shingle s JOIN notice n USING (shingle)),
win AS (SELECT doc_id, number, license, shingle, unnest([i // CAST(power(2, k) AS BIGINT), i // CAST(power(2, k) AS BIGINT) - 1]) AS "at" FROM hit),
share AS (SELECT doc_id, number, license, "at", count(DISTINCT shingle) AS held FROM win GROUP BY ALL)
SELECT doc_id, license, round(max(held / n), 6) AS containment FROM share JOIN size USING (number) WHERE held / n * 100 >= 75 GROUP BY doc_id, license
"""
