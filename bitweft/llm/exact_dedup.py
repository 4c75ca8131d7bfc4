"""Exact dedup over a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after deleting ASCII white space ([\\x20\\x09-\\x0D]); null counts as empty.
New data is grouped by digest with map-side combine (a group of any size becomes one row before the
shuffle), the groups are dedup'ed against the index by a sort-merge anti-join and the new digests are
appended, bucketed and sorted by digest.

Ids may be of any type that can be ordered. Edge cases: null text = empty text, empty texts are equal to each other; a row without id can stay only if
its group has no row with an id; ties in length go to the smallest id, repeated rows with the id that stays
are all marked kept by verdicts() (they carry one id) and reduced to one row by survivors(); an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.session import Workspace, pick, small, table

#: Characters that do not count, fixed by the contract: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"

#: A group with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 4096


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (32 bytes), chars: a row per document."""
    d = pick(docs, id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    return d.select("id", F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("digest"), F.char_length(text).alias("chars"))


class DigestIndex:
    """Digest -> id of the row that stays, in a table bucketed and sorted by digest.

    Buckets and order let the anti-join read the index without a shuffle or a sort. The table lives at a
    path in the shared folder, so another session reopens it with the same path, bucket count and type of ids. Its
    name leaves the catalog with close(); the data stay."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "bitweft_digests_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, chars INT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks."""
        return groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add groups() of digests that the index lacks."""
        (groups.select("digest", "keep_id", "chars", "group_size").repartition(self.buckets, "digest")
         .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.path).saveAsTable(self.name))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Deduplicate new data against itself and the index and append what is new; earlier data stays."""
        self.append(self.unseen(groups(digests(docs, id_col, text_col))))


def groups(rows: DataFrame) -> DataFrame:
    """digest, keep_id, chars, group_size: the longest original stays, then the smallest id (null last)."""
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), (-F.col("chars")).alias("less"), F.col("id").alias("id")))
    return rows.groupBy("digest").agg(first.alias("m"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("m.id").alias("keep_id"), (-F.col("m.less")).alias("chars"), "group_size")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """A row per document: id, keep_id, group_size (rows of docs), kept, text_sha256. Appends what `index` lacks (else a
    new index is made, which goes with the application). A digest that the index knew before keeps the index's id,
    so data that are added a second time append nothing and get the same verdicts."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    rows = ws.put(digests(docs, id_col, text_col), "digests")
    own = index is None
    if own:
        index = DigestIndex(spark, ws.path("index"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), rows.schema["id"].dataType.simpleString())
    grouped = ws.put(groups(rows), "groups")
    index.append(index.unseen(grouped))
    known = grouped.hint("merge").join(index.read().select("digest", F.col("keep_id").alias("first_id")).hint("merge"), "digest").select("digest", F.col("first_id").alias("keep_id"), "group_size") if not own else grouped.select("digest", "keep_id", "group_size")
    # Hot groups number fewer than HOT_SHARE by their definition, so broadcasting them is bounded; in the
    # join of the rest no key has more than 1/HOT_SHARE of the rows.
    total = rows.count()
    least = max(total // HOT_SHARE, 1000)
    hot = known.where(F.col("group_size") > least)
    on_hot = rows.join(F.broadcast(hot), "digest", "left")
    in_hot = on_hot.where(F.col("group_size").isNotNull())
    rest = on_hot.where(F.col("group_size").isNull()).drop("keep_id", "group_size").join(known.where(F.col("group_size") <= least), "digest")
    if own:
        index.close()
    return in_hot.select(*(cols := ["id", "digest", "keep_id", "group_size"])).unionByName(rest.select(*cols)).select(
        "id", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    ws = Workspace(docs.sparkSession, "survivors")
    gone = ws.put(verdicts(docs, id_col, text_col).where("NOT kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__want")).distinct(), "gone")
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    key, text = F.col(f"__c{names.index(id_col)}"), F.coalesce(F.col(f"__c{names.index(text_col)}"), F.lit(""))
    keyed = plain.withColumn("__sha", F.sha2(F.translate(text, WHITE, ""), 256))
    out = keyed.join(small(gone), key.eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__want")), "left_anti")
    out = out.dropDuplicates([f"__c{names.index(id_col)}", "__sha"]) if rows_repeated(docs, id_col) else out
    return out.drop("__sha").toDF(*names)


def rows_repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether any id (or null) comes twice: only then do kept rows have to be reduced to one an id."""
    d = pick(docs, id=id_col)
    return bool(d.groupBy("id").count().where("count > 1").limit(1).count())


#: Session setting: the path of a persistent digest index for the query; unset, each run starts with an empty one.
INDEX_PATH = "spark.bitweft.digestIndex"


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(INDEX_PATH, "")
    index = DigestIndex(spark, path, int(spark.conf.get(INDEX_PATH + ".buckets", "64"))) if path else None
    return verdicts(table(spark, sf_dir, "documents"), index=index).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT h, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN k USING (h)
"""
