"""Line dedup with overlapping three-line windows.

Every three consecutive lines of a document are a window. Windows that repeat anywhere in the corpus are found
by their digest; of equal windows the first, by (id, line), stays and every later one is marked. All lines
that marked windows cover are removed. As each removed line stands in an earlier window too, the first place
of every line of the corpus always stays. All DataFrame operations.

The digest of a window is the MD5 of its lines, joined by line feeds (lines hold none). A window that a third
of all documents hold is one row after map-side combining; the join that marks later windows meets written
tables on both sides, so that a hot window's rows can be split. Texts meet their marked windows in a sort-merge
join by id at every size: the marked windows grow with the corpus, so they are never broadcast.

Edge cases: null text is empty; documents of less than three lines have no window and stay as they are; rows
without id never lose lines nor take part; rows with one id are one document, whose windows count once each
and place; repeated rows stay repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.session import Workspace, pick, table

WINDOW = 3


def windows(lines: Column) -> Column:
    """Digests of all windows of WINDOW consecutive lines, in order."""
    n = F.greatest(F.size(lines) - (WINDOW - 1), F.lit(0))
    rows = F.arrays_zip(*[F.slice(lines, k + 1, n).alias(f"l{k}") for k in range(WINDOW)])
    return F.transform(rows, lambda r: F.unhex(F.md5(F.concat_ws("\n", *[r[f"l{k}"] for k in range(WINDOW)]))))


def repeated(docs: DataFrame) -> tuple[Workspace, DataFrame]:
    """For docs(id, text): the workspace and id, starts: the windows to remove of each document that has any."""
    ws = Workspace(docs.sparkSession, "lines")
    lines = F.split(F.col("text"), "\n", -1)
    rows = docs.where(F.col("id").isNotNull() & F.contains(F.col("text"), F.lit("\n"))).select("id", F.posexplode(windows(lines)).alias("at", "digest"))
    rows = ws.put(rows, "windows")
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"))
    first = ws.put(first, "first")
    later = rows.join(first, "digest").where((F.col("id") != F.col("first_id")) | (F.col("at") != F.col("first_at")))
    return ws, ws.put(later.groupBy("id").agg(F.collect_set("at").alias("starts")), "later")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_lines, n_removed, text (the lines that stay, joined by line feeds)."""
    d = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    _, later = repeated(d)
    marked = later.select(F.col("id").alias("__id"), "starts").hint("merge")
    # Rows without id pass by the join, which would send them all to one task.
    out = d.where(F.col("id").isNotNull()).join(marked, F.col("id") == F.col("__id"), "left").select("id", "text", "starts")
    out = out.unionByName(d.where(F.col("id").isNull()).withColumn("starts", F.lit(None).cast(later.schema["starts"].dataType)))
    lines = F.split(F.col("text"), "\n", -1)
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    covered = F.flatten(F.transform(F.col("starts"), lambda s: F.array(*[s + k for k in range(WINDOW)])))
    stay = F.array_except(every, covered)
    out = out.withColumn("lines", lines).withColumn("stay", F.when(F.col("starts").isNotNull(), stay))
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at("lines", i + 1)), "\n"))
    n = F.size("lines").cast("long")
    return out.select("id", n.alias("n_lines"), F.when(F.col("starts").isNull(), F.lit(0)).otherwise(n - F.size("stay")).cast("long").alias("n_removed"), text.alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "text")


SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS place, list_slice(ls, i + 1, i + 3) AS w FROM l, unnest(range(0, len(ls) - 2)) AS u(i) WHERE len(ls) >= 3),
r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY w ORDER BY doc_id, place) AS k FROM w),
c AS (SELECT DISTINCT doc_id, place + j AS line FROM r, unnest([0, 1, 2]) AS u(j) WHERE k > 1),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       array_to_string([ls[i + 1] FOR i IN range(0, len(ls)) IF NOT list_contains(coalesce(gone, []), i)], chr(10)) AS text
FROM l LEFT JOIN g ON g.doc_id = l.doc_id
"""
