"""The held-out queries over all rows: two folds, even and odd ids. Each half trains the models that score the other.

The queries of the same names without `_folds` train on even ids and score odd ones only, as their SQL states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweft.operators import grams, ppm
from bitweft.plans import models, scoring
from bitweft.plans import ppm_sql as Q
from bitweft.plans.base import ORACLES, query
from bitweft.session import Workspace, table

_ROLE, _TURN = "SELECT role AS model, conv_id * 1000 + turn AS doc, text FROM conversations WHERE conv_id % 2 = 0", "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE conv_id % 2 = 1"


def halves(df: DataFrame, id_col: str) -> list[tuple[DataFrame, DataFrame]]:
    """(training rows, scored rows) of both folds; odd ids may be negative."""
    even, odd = df.where(F.col(id_col) % 2 == 0), df.where(F.col(id_col) % 2 != 0)
    return [(even, odd), (odd, even)]


def fold_costs(df: DataFrame, id_col: str, key: str, order: int) -> DataFrame:
    """key, model, bits, symbols of every row of df(key, id_col, model, text) under the models of the other half.

    The grams of both halves are counted in one reading: each half's train its models and are priced by the other's."""
    half = (F.col(id_col) % 2 != 0).cast("int")
    base = grams.counted(df.select("model", half.alias("__half"), "text"), ["__half", "model"], max(order, 0))
    base = Workspace(df.sparkSession, "grams").put(base, "halves")
    parts = []
    for h, (_, test) in enumerate(halves(df, id_col)):
        wanted = base.where(F.col("__half") == 1 - h).select("ctx", "s").distinct()
        counts = ppm.trained(base.where(F.col("__half") == h).drop("__half"), order)
        parts.append(ppm.codelengths(test.select(key, "text"), key, counts, order, wanted=wanted))
    return reduce(DataFrame.unionByName, parts)


def swapped(sql: str) -> str:
    return sql.replace("% 2 = 0", "% 2 = #").replace("% 2 = 1", "% 2 = 0").replace("% 2 = #", "% 2 = 1")


def folds_sql(name: str, train: str, test: str, key: str, order: int) -> str:
    """The SQL of query `name` with the code lengths of both folds."""
    one = Q.codelengths(train, test, key, order)
    assert one in ORACLES[name]
    return ORACLES[name].replace(one, f"WITH cl AS (SELECT * FROM ({one} SELECT * FROM cl) UNION ALL SELECT * FROM ({swapped(one)} SELECT * FROM cl))")


def language_costs(spark, sf, order):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", "text"), fold_costs(d.select("doc_id", F.col("lang").alias("model"), "text"), "doc_id", "doc_id", order)


def role_costs(spark, sf, order):
    t = scoring.turns(spark, sf)
    return t, fold_costs(t.withColumn("id", F.col("doc")), "conv_id", "id", order)


def toxic_costs(spark, sf, order):
    d = scoring.labelled(spark, sf)
    return d, fold_costs(d, "doc_id", "doc_id", order)


def _language(name: str, order: int) -> str:
    return folds_sql(name, scoring._EVEN, scoring._ODD, "doc_id", order)


@query(_language("lang_id_static", 2))
def lang_id_static_folds(spark, sf):
    """Language identification of every document, order 2."""
    return scoring.of_lang_id_static(*language_costs(spark, sf, 2))


@query(_language("lang_id_precision", 1))
def lang_id_precision_folds(spark, sf):
    """Precision at the first rank over every document."""
    return scoring.of_lang_id_precision(*language_costs(spark, sf, 1))


@query(_language("lang_confusion", 1))
def lang_confusion_folds(spark, sf):
    """Precision and recall of each class over every document."""
    return scoring.of_lang_confusion(*language_costs(spark, sf, 1))


@query(_language("lang_bits_matrix", 1))
def lang_bits_matrix_folds(spark, sf):
    """Cost of every document under every model of the other half."""
    return scoring.of_lang_bits_matrix(*language_costs(spark, sf, 1))


@query(_language("bits_json", 0))
def bits_json_folds(spark, sf):
    """JSON object of bits by model for every document."""
    return scoring.of_bits_json(*language_costs(spark, sf, 0))


@query(folds_sql("role_id_conversations", _ROLE, _TURN, "id", 2))
def role_id_conversations_folds(spark, sf):
    """Who speaks, for every turn."""
    return scoring.of_role_id_conversations(*role_costs(spark, sf, 2))


@query(folds_sql("toxic_id_labels", scoring._TOX, scoring._TOXT, "doc_id", 1))
def toxic_id_labels_folds(spark, sf):
    """Binary identification of every labelled document."""
    return scoring.of_toxic_id_labels(*toxic_costs(spark, sf, 1))


@query(f"SELECT * FROM ({ORACLES['bigram_pt_bits']}) UNION ALL SELECT * FROM ({swapped(ORACLES['bigram_pt_bits'])})")
def bigram_pt_bits_folds(spark, sf):
    """Word model with back-off over every conversation."""
    p = reduce(DataFrame.unionByName, [models.pair_bits(a, b) for a, b in halves(models.word_pairs(spark, sf), "conv_id")])
    return p.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("words"), F.round(F.sum("bits"), 4).alias("bits"))


_TAG = ORACLES["tag_back_off_bits"].replace("round(sum(bits), 4)", "sum(bits)")


@query(f"SELECT tag, CAST(sum(words) AS BIGINT) AS words, round(sum(bits), 4) AS bits FROM (SELECT * FROM ({_TAG}) UNION ALL SELECT * FROM ({swapped(_TAG)})) GROUP BY tag")
def tag_back_off_bits_folds(spark, sf):
    """Tag model over every conversation."""
    w = models.word_pairs(spark, sf).withColumn("prev", F.col("role"))
    p = reduce(DataFrame.unionByName, [models.pair_bits(a, b) for a, b in halves(w, "conv_id")])
    return p.groupBy(F.col("prev").alias("tag")).agg(F.count(F.lit(1)).alias("words"), F.round(F.sum("bits"), 4).alias("bits"))
