"""Word models: words and the nonwords between them are two streams of tokens, each predicted by the token before it in
its own stream; a token that training has not seen is spelled by a character model of its stream.

A text is (nonword, word) pairs. An empty last word becomes the sentinel; otherwise one more nonword, the sentinel, ends the
text (null: empty). Behind a nonword that ends a sentence the context of nonwords is the sentinel. A token costs its share in
the context of its predecessor, or an escape and its share among all tokens of the stream, or two escapes and its
characters; an escape has the weight of the types of its level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweft.functions.text import SENTINEL, nonword_words
from bitweft.operators import ppm
from bitweft.session import Workspace, small


def ends_sentence(nonword: Column) -> Column:
    return nonword.contains(". ") | nonword.contains(".\n") | (nonword == ".")


def streams(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, kind (n or w), prev, token: every token of each row's text with its context, from the row's own arrays."""
    end = F.lit(SENTINEL)
    rows = df.select(*keys, nonword_words(F.coalesce(F.col(text), F.lit(""))).alias("__p"))
    open_ = F.coalesce(F.get("__p", F.size("__p") - 1)["word"] != "", F.lit(True))
    non = F.concat(F.transform("__p", lambda x: x["nonword"]), F.when(open_, F.array(end)).otherwise(F.array().cast("array<string>")))
    word = F.transform("__p", lambda x: F.when(x["word"] == "", end).otherwise(x["word"]))
    rows = rows.select(*keys, non.alias("__n"), word.alias("__w"))
    past = F.concat(F.array(end), F.transform("__n", lambda x: F.when(ends_sentence(x), end).otherwise(x)))
    of = lambda kind, tokens, before: F.transform(F.arrays_zip(F.col(tokens).alias("token"), before.alias("prev")), lambda z: F.struct(F.lit(kind).alias("kind"), z["prev"].alias("prev"), z["token"].alias("token")))
    both = F.concat(of("n", "__n", past), of("w", "__w", F.concat(F.array(end), F.col("__w"))))
    return rows.select(*keys, F.explode(both).alias("z")).select(*keys, "z.kind", "z.prev", "z.token").where("token IS NOT NULL")


def train(df: DataFrame, model: str = "model", text: str = "text", order: int = 2) -> tuple[DataFrame, DataFrame]:
    """The bundle: pairs(model, kind, prev, token, n), of which the tables of tokens are sums, and the count tables of the
    character models (named model/kind), trained on each token of a stream once. Both are written tables."""
    pairs = streams(df.withColumnRenamed(model, "model"), ["model"], text).groupBy("model", "kind", "prev", "token").agg(F.count(F.lit(1)).alias("n"))
    pairs = Workspace(df.sparkSession, "words").put(pairs, "pairs")
    once = pairs.where(F.col("token") != SENTINEL).select(F.concat_ws("/", "model", "kind").alias("model"), F.col("token").alias("text")).distinct()
    return pairs, ppm.train(once, order)


def write(bundle: tuple[DataFrame, DataFrame], path: str) -> None:
    """The bundle's two tables below one folder, by stream and order (not by model: names read from folders lose their type)."""
    bundle[0].write.mode("overwrite").partitionBy("kind").parquet(f"{path}/pairs")
    bundle[1].write.mode("overwrite").partitionBy("k").parquet(f"{path}/characters")


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/characters")


#: Models whose counts stand side by side in one row; more are taken in turns.
ABREAST = 32


def codelengths(df: DataFrame, key: str, bundle: tuple[DataFrame, DataFrame], text: str = "text", order: int = 2, alphabet: int = 65536) -> DataFrame:
    """key, model, bits, symbols (tokens): the cost of each text under every model of the bundle.

    Distinct (context, token) pairs are priced once, under all models in one row, so that a pair is dealt out once and not
    once a model; the tokens of a text are not gathered before."""
    pairs, characters = bundle
    mine = Workspace(df.sparkSession, "words").put(streams(df, [key], text), "tokens")
    names = [r.model for r in pairs.select("model").distinct().collect()]
    parts = [_codelengths(mine, key, pairs, characters, names[i : i + ABREAST], order, alphabet) for i in range(0, len(names), ABREAST)]
    if not parts:
        return mine.select(key, F.lit(None).cast(pairs.schema["model"].dataType).alias("model"), F.lit(0.0).alias("bits"), F.lit(0).cast("long").alias("symbols")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _codelengths(mine: DataFrame, key: str, pairs: DataFrame, characters: DataFrame, names: list, order: int, alphabet: int) -> DataFrame:
    each, none = range(len(names)), F.lit(0.0)
    of = lambda i: F.col("model").eqNullSafe(F.lit(names[i]))
    wide = lambda column, what: [F.sum(F.when(of(i), F.col(column))).alias(f"{what}_{i}") for i in each]
    own = reduce(Column.__or__, [of(i) for i in each])
    pairs = pairs.where(own)
    context = pairs.groupBy("kind", "prev").agg(*wide("n", "n1"), *[F.count(F.when(of(i), 1)).alias(f"t1_{i}") for i in each])
    single = pairs.groupBy("kind", "token").agg(*wide("n", "c0"))
    zero = single.groupBy("kind").agg(*[F.sum(f"c0_{i}").alias(f"n0_{i}") for i in each], *[F.count(f"c0_{i}").alias(f"t0_{i}") for i in each])
    # Pairs that are asked for and pairs that are known meet in one sum.
    asked = mine.select("kind", "prev", "token", F.lit(True).alias("__asked"), F.lit(None).cast(pairs.schema["model"].dataType).alias("model"), F.lit(None).cast("long").alias("n"))
    both = asked.unionByName(pairs.select("kind", "prev", "token", F.lit(False).alias("__asked"), "model", "n"))
    want = both.groupBy("kind", "prev", "token").agg(F.max("__asked").alias("__asked"), *wide("n", "c1")).where("__asked").drop("__asked")
    # Tokens with the cost of each as a token of no context: its share, or its characters if a model has not seen it.
    tokens = Workspace(mine.sparkSession, "words").put(mine.select("kind", "token").distinct().join(single, ["kind", "token"], "left"), "vocabulary")
    new = tokens.where(F.col("token") != SENTINEL).where(reduce(Column.__or__, [F.col(f"c0_{i}").isNull() for i in each]))
    kinds = characters.where(reduce(Column.__or__, [F.col("model") == F.concat_ws("/", F.lit(m), F.lit(k)) for m in names for k in ("n", "w")]))
    spelled = ppm.codelengths(new.select("token").distinct(), "token", kinds, order, alphabet, text="token")
    by = lambda i: F.col("model") == F.concat_ws("/", F.lit(names[i]), "kind")
    spelled = spelled.withColumn("kind", F.element_at(F.split("model", "/"), -1)).groupBy("kind", "token").agg(*[F.max(F.when(by(i), F.col("bits"))).alias(f"sp_{i}") for i in each])
    second = []
    known = tokens.join(spelled, ["kind", "token"], "left").join(small(zero, ppm.LEVEL_ROWS), "kind", "left")
    for i in each:
        c0, n0, t0 = (F.col(f"{x}_{i}") for x in ("c0", "n0", "t0"))
        share = F.when(n0.isNull(), none).otherwise(-F.log2(F.coalesce(c0, t0) / (n0 + t0)))
        letters = F.when(c0.isNull() & (F.col("token") != SENTINEL), F.coalesce(f"sp_{i}", (F.char_length("token") + 1) * F.log2(F.lit(alphabet + 1.0)))).otherwise(none)
        second.append((share + letters).alias(f"s_{i}"))
    want = want.join(small(context, ppm.LEVEL_ROWS), ["kind", "prev"], "left")
    first = []
    for i in each:
        c1, n1, t1 = (F.col(f"{x}_{i}") for x in ("c1", "n1", "t1"))
        hit = -F.log2(c1 / (n1 + t1))  # below the escape, marked by its sign: a share costs at least 0, an escape is put as -1 - cost
        first.append(F.when(c1.isNotNull(), hit).when(n1.isNotNull(), -1 + F.log2(t1 / (n1 + t1))).otherwise(F.lit(-1.0)).alias(f"f_{i}"))
    priced = want.select("kind", "prev", "token", *first).join(known.select("kind", "token", *second), ["kind", "token"])
    priced = priced.select("kind", "prev", "token", *[F.when(F.col(f"f_{i}") >= 0, F.col(f"f_{i}")).otherwise(-1 - F.col(f"f_{i}") + F.col(f"s_{i}")).alias(f"b_{i}") for i in each])
    total = mine.join(priced, ["kind", "prev", "token"]).groupBy(key).agg(F.count(F.lit(1)).alias("symbols"), *[F.sum(f"b_{i}").alias(f"b_{i}") for i in each])
    model = pairs.schema["model"].dataType
    rows = F.explode(F.array(*[F.struct(F.lit(names[i]).cast(model).alias("model"), F.col(f"b_{i}").alias("bits")) for i in each]))
    return total.select(key, rows.alias("e"), "symbols").select(key, "e.model", "e.bits", "symbols")
