"""Codelengths and what follows from them: identification, evaluation, curves, distributions, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweft.functions import text as T
from bitweft.operators import fold, ppm
from bitweft.plans import ppm_sql as Q
from bitweft.plans.base import query
from bitweft.plans.models import TURNS, turns
from bitweft.session import table

_EVEN = "SELECT lang AS model, doc_id AS doc, text FROM documents WHERE doc_id % 2 = 0"
_ODD = "SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1"


def split_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("doc_id % 2 = 0").select(F.col("lang").alias("model"), "text"), d.where("doc_id % 2 = 1").select("doc_id", "lang", "text")


def identify(costs: DataFrame, key: str) -> DataFrame:
    """key, predicted, bits, runner_up, symbols: the cheapest model (at equal bits the first) and the next one.

    A text has one row per model, so the sorted list of a key is as short as the list of models; costs are read once."""
    ranked = F.array_sort(F.collect_list(F.struct(F.round("bits", 6).alias("r"), "model", "bits", "symbols")))
    best = costs.groupBy(key).agg(ranked.alias("a"))
    return best.select(key, F.get("a", F.lit(0))["model"].alias("predicted"), F.get("a", F.lit(0))["bits"].alias("bits"), F.get("a", F.lit(1))["model"].alias("runner_up"), F.get("a", F.lit(0))["symbols"].alias("symbols"))


def identify_sql(cte: str, key: str) -> str:
    return f"{cte},\nrk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(bits, 6), model) AS r FROM cl),\nbest AS (SELECT a.{key}, a.model AS predicted, a.bits, a.symbols, b.model AS runner_up FROM rk a LEFT JOIN rk b ON b.{key} = a.{key} AND b.r = 2 WHERE a.r = 1)"


def lang_costs(spark, sf, order):
    train, test = split_docs(spark, sf)
    return test, ppm.codelengths(test, "doc_id", ppm.train(train, order), order)


_ID2 = identify_sql(Q.codelengths(_EVEN, _ODD, "doc_id", 2), "doc_id")
_ID1 = identify_sql(Q.codelengths(_EVEN, _ODD, "doc_id", 1), "doc_id")


def of_lang_id_static(test, costs):
    d = test.select("doc_id", "lang", F.char_length("text").alias("n"))
    return identify(costs, "doc_id").join(d, "doc_id").select("doc_id", "lang", "predicted", F.round("bits", 4).alias("bits"), F.round(F.col("bits") / F.col("n"), 6).alias("bits_per_char"), "runner_up")


@query(f"{_ID2} SELECT doc_id, lang, predicted, round(bits, 4) AS bits, round(bits / length(text), 6) AS bits_per_char, runner_up FROM best JOIN documents USING (doc_id)")
def lang_id_static(spark, sf):
    """Language identification by minimum code length, order 2: even documents train, odd ones are identified."""
    return of_lang_id_static(*lang_costs(spark, sf, 2))


def of_lang_id_precision(test, costs):
    hit = F.when(F.col("true") == F.col("predicted"), 1).otherwise(0)
    r = identify(costs, "doc_id").join(test.select("doc_id", "lang", F.col("lang").alias("true")), "doc_id").rollup("lang")
    return r.agg(F.count(F.lit(1)).alias("docs"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("precision_at_1")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(f"{_ID1} SELECT coalesce(lang, 'all') AS lang, count(*) AS docs, CAST(count(*) FILTER (WHERE lang0 = predicted) AS BIGINT) AS hits, round(avg(CASE WHEN lang0 = predicted THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1 FROM (SELECT lang, lang AS lang0, predicted FROM best JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang)")
def lang_id_precision(spark, sf):
    """Precision at the first rank, by language and over all."""
    return of_lang_id_precision(*lang_costs(spark, sf, 1))


def of_lang_confusion(test, costs):
    m = identify(costs, "doc_id").join(test.select("doc_id", "lang"), "doc_id").groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n"))
    t = m.groupBy(F.col("lang").alias("tag")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("lang") == F.col("predicted"), F.col("n")).otherwise(0)).alias("h"))
    p = m.groupBy(F.col("predicted").alias("tag")).agg(F.sum("n").alias("p"))
    return t.join(p, "tag", "left").select("tag", F.round(F.col("h") / F.col("p"), 6).alias("precision"), F.round(F.col("h") / F.col("t"), 6).alias("recall"))


@query(f"""{_ID1}, m AS (SELECT lang, predicted FROM best JOIN documents USING (doc_id)), t AS (SELECT lang AS tag, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT predicted AS tag, count(*) AS n FROM m GROUP BY ALL), h AS (SELECT lang AS tag, count(*) AS n FROM m WHERE lang = predicted GROUP BY ALL)
SELECT tag, round(coalesce(h.n, 0) / p.n, 6) AS "precision", round(coalesce(h.n, 0) / t.n, 6) AS recall FROM t LEFT JOIN p USING (tag) LEFT JOIN h USING (tag)""")
def lang_confusion(spark, sf):
    """Precision and recall of each class."""
    return of_lang_confusion(*lang_costs(spark, sf, 1))


def of_lang_bits_matrix(_, costs):
    return costs.select("doc_id", "model", F.round("bits", 4).alias("bits"), F.round(F.col("bits") / F.col("symbols"), 6).alias("per_symbol"), F.round(F.col("bits") / (F.col("symbols") - 1), 6).alias("per_char"))


@query(f"{Q.codelengths(_EVEN, _ODD, 'doc_id', 1)} SELECT doc_id, model, round(bits, 4) AS bits, round(bits / symbols, 6) AS per_symbol, round(bits / (symbols - 1), 6) AS per_char FROM cl")
def lang_bits_matrix(spark, sf):
    """Cost of every document under every model; cross-entropy with and without the sentinel in the length."""
    return of_lang_bits_matrix(*lang_costs(spark, sf, 1))


def of_bits_json(_, costs):
    pairs = F.array_sort(F.collect_list(F.struct("model", F.round("bits").cast("long").alias("bits"))))
    return costs.groupBy("doc_id").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


@query(f"""{Q.codelengths(_EVEN, _ODD, 'doc_id', 0)} SELECT doc_id, '{{' || string_agg('"' || model || '":' || CAST(CAST(round(bits) AS BIGINT) AS VARCHAR), ',' ORDER BY model) || '}}' AS json FROM cl GROUP BY doc_id""")
def bits_json(spark, sf):
    """JSON object of bits by model for each document."""
    return of_bits_json(*lang_costs(spark, sf, 0))


def role_model(spark, sf, order):
    return ppm.train(turns(spark, sf), order)


_ITEMS = "SELECT item_id, text FROM benchmark"
_LINES = "SELECT item_id, unnest(range(0, len(l))) AS line, unnest(l) AS text FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark)"


def per_symbol_sql(test: str, keys: str, order: int, sentinel: bool = True) -> str:
    return "WITH " + ",\n".join([Q.train(TURNS, order), Q.symbols("te", test, keys, order, sentinel), f"tx AS (SELECT *, {Q.longest(order)} AS ctx FROM te)", Q.scored("SELECT DISTINCT m.model, tx.ctx, tx.s FROM tx, (SELECT DISTINCT model FROM counts) m", order), f"ps AS (SELECT {keys}, pos, s, model, bits FROM tx JOIN costs USING (ctx, s))"])


def of_line_bits_max(spark, sf, order):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    g = ppm.per_symbol(b, ["item_id", "line"], role_model(spark, sf, order), order).groupBy("item_id", "line", "model").agg(F.sum("bits").alias("b"))
    return g.groupBy("item_id", "model").agg(F.count(F.lit(1)).alias("lines"), F.round(F.max("b"), 4).alias("most"), F.round(F.avg("b"), 4).alias("mean"))


@query(f"{per_symbol_sql(_LINES, 'item_id, line', 2)}, li AS (SELECT item_id, line, model, sum(bits) AS b FROM ps GROUP BY ALL) SELECT item_id, model, count(*) AS lines, round(max(b), 4) AS most, round(avg(b), 4) AS mean FROM li GROUP BY ALL")
def line_bits_max(spark, sf):
    """Cost of each line on its own: mean and maximum of each text."""
    return of_line_bits_max(spark, sf, 2)


@query(f"""{per_symbol_sql(_ITEMS, 'item_id', 2)}, rs AS (SELECT item_id, model, pos, sum(bits) OVER (PARTITION BY item_id, model ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM ps)
SELECT item_id, model, CAST(pos + 1 AS BIGINT) AS pos, round(run, 4) AS bits, round(run / (pos + 1), 6) AS bpc FROM rs WHERE (pos + 1) % 25 = 0""")
def learning_curve(spark, sf):
    """Running cost and bits per character every 25 symbols."""
    p = ppm.per_symbol(table(spark, sf, "benchmark"), ["item_id"], role_model(spark, sf, 2), 2)
    w = Window.partitionBy("item_id", "model").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = p.withColumn("run", F.sum("bits").over(w)).where("(pos + 1) % 25 = 0")
    return r.select("item_id", "model", (F.col("pos") + 1).cast("long").alias("pos"), F.round("run", 4).alias("bits"), F.round(F.col("run") / (F.col("pos") + 1), 6).alias("bpc"))


@query(f"{per_symbol_sql(_ITEMS, 'item_id', 1)} SELECT item_id, CAST(pos AS BIGINT) AS pos, model, round(pow(2, -bits), 8) AS p FROM ps")
def symbol_probabilities(spark, sf):
    """Probability of every symbol under all models at once."""
    p = ppm.per_symbol(table(spark, sf, "benchmark"), ["item_id"], role_model(spark, sf, 1), 1)
    return p.select("item_id", F.col("pos").cast("long").alias("pos"), "model", F.round(F.pow(F.lit(2.0), -F.col("bits")), 8).alias("p"))


@query(f"WITH {Q.train(TURNS, 2)},\n{Q.scored('SELECT k.model, x.ctx, k.s FROM (SELECT model, s FROM counts WHERE k = 0) k, (SELECT DISTINCT ctx FROM counts WHERE k <= 1) x', 2)} SELECT model, ctx, s, round(bits, 6) AS bits FROM costs")
def next_symbol_costs(spark, sf):
    """Cost of every next symbol after every context of at most one symbol (each symbol once)."""
    counts = role_model(spark, sf, 2)
    ctx = counts.where("k <= 1").select("ctx").distinct().crossJoin(F.broadcast(counts.select("model").distinct()))
    return ppm.distribution(counts, ctx, 2).select("model", "ctx", "s", F.round("bits", 6).alias("bits"))


@query(f"""WITH {Q.train(TURNS, 1)} SELECT model, ctx, s, CAST(sum(cnt) OVER (PARTITION BY model, ctx ORDER BY s ROWS UNBOUNDED PRECEDING) - cnt AS BIGINT) AS low, CAST(sum(cnt) OVER (PARTITION BY model, ctx ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high,
CAST(sum(cnt) OVER (PARTITION BY model, ctx) + count(*) OVER (PARTITION BY model, ctx) AS BIGINT) AS total FROM counts WHERE k = 1""")
def coding_ranges(spark, sf):
    """Coding ranges of the followers of every context of one symbol; the rest of the total is the escape's."""
    c = role_model(spark, sf, 1).where("k = 1")
    p = Window.partitionBy("model", "ctx")
    run = F.sum("cnt").over(p.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("model", "ctx", "s", (run - F.col("cnt")).alias("low"), run.alias("high"), (F.sum("cnt").over(p) + F.count(F.lit(1)).over(p)).alias("total"))


@query("WITH " + ",\n".join([Q.train(TURNS, 2), Q.symbols("te", _ITEMS, "item_id", 2), f"tx AS (SELECT *, {Q.longest(2)} AS ctx FROM te)", Q.levels("SELECT DISTINCT m.model, tx.ctx, tx.s FROM tx, (SELECT DISTINCT model FROM counts) m", 2)]) + """
SELECT item_id, lv.model, round(sum(CASE WHEN types2 IS NOT NULL THEN -log2(cnt2 / total2) WHEN types1 IS NOT NULL THEN -log2(cnt1 / total1) ELSE -log2(cnt0 / total0) END), 4) AS bits,
CAST(count(*) FILTER (WHERE CASE WHEN types2 IS NOT NULL THEN cnt2 WHEN types1 IS NOT NULL THEN cnt1 ELSE cnt0 END IS NULL) AS BIGINT) AS misses FROM tx JOIN lv ON lv.ctx = tx.ctx AND lv.s = tx.s GROUP BY ALL""")
def maxorder_bits(spark, sf):
    """Cost in the longest context only; new symbols are counted as misses."""
    counts = role_model(spark, sf, 2)
    g = ppm.gram_counts(table(spark, sf, "benchmark"), ["item_id"], 2)
    t = g.select("ctx", "s").distinct().crossJoin(F.broadcast(counts.select("model").distinct()))
    m = g.join(ppm.max_order_bits(t, counts, 2), ["ctx", "s"])
    return m.groupBy("item_id", "model").agg(F.round(F.sum(F.col("n") * F.col("bits")), 4).alias("bits"), F.sum(F.when(F.col("bits").isNull(), F.col("n")).otherwise(0)).alias("misses"))


_RID = identify_sql(Q.codelengths("SELECT role AS model, conv_id * 1000 + turn AS doc, text FROM conversations WHERE conv_id % 2 = 0", "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE conv_id % 2 = 1", "id", 2), "id")


def of_role_id_conversations(t, costs):
    return identify(costs, "id").join(t.select(F.col("doc").alias("id"), F.col("model").alias("role")), "id").select("id", "role", "predicted", F.round("bits", 4).alias("bits"))


@query(f"{_RID} SELECT id, role, predicted, round(bits, 4) AS bits FROM best JOIN (SELECT conv_id * 1000 + turn AS id, role FROM conversations) USING (id)")
def role_id_conversations(spark, sf):
    """Who speaks: even conversations train a model per role, odd ones are identified."""
    t = turns(spark, sf)
    costs = ppm.codelengths(t.where("conv_id % 2 = 1").withColumnRenamed("doc", "id"), "id", ppm.train(t.where("conv_id % 2 = 0"), 2), 2)
    return of_role_id_conversations(t, costs)


_TOX = "SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS model, doc_id AS doc, text FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0"
_TOXT = "SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1"


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("model", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))


def of_toxic_id_labels(d, costs):
    return identify(costs, "doc_id").join(d.select("doc_id", "toxic"), "doc_id").groupBy(F.col("toxic").cast("long").alias("toxic"), "predicted").agg(F.count(F.lit(1)).alias("docs"))


@query(f"{identify_sql(Q.codelengths(_TOX, _TOXT, 'doc_id', 1), 'doc_id')} SELECT CAST(toxic AS BIGINT) AS toxic, predicted, count(*) AS docs FROM best JOIN labels USING (doc_id) GROUP BY ALL")
def toxic_id_labels(spark, sf):
    """Binary identification on labelled documents: confusion counts."""
    d = labelled(spark, sf)
    costs = ppm.codelengths(d.where("doc_id % 2 = 1"), "doc_id", ppm.train(d.where("doc_id % 2 = 0"), 1), 1)
    return of_toxic_id_labels(d, costs)


_ALL = "SELECT 'all' AS model, conv_id * 1000 + turn AS doc, text FROM conversations"


def metrics_sql() -> str:
    topic = per_symbol_sql(_ITEMS, "item_id", 1, sentinel=False)
    return f"""WITH a AS ({topic} SELECT * FROM ps), b AS ({topic.replace(TURNS, _ALL)} SELECT * FROM ps)
SELECT a.item_id, a.model AS topic, round(sum(a.bits), 4) AS cross_entropy, round(sum(abs(a.bits - b.bits)), 4) AS topic_collection, round(sum(a.bits - b.bits), 4) AS topic_collection_signed FROM a JOIN b ON b.item_id = a.item_id AND b.pos = a.pos GROUP BY ALL"""


def topic_and_collection(spark, sf):
    """item_id, pos, topic, t, c: costs of each symbol under each role's model and under the model of all turns."""
    b, t = table(spark, sf, "benchmark"), turns(spark, sf)
    topic = ppm.per_symbol(b, ["item_id"], role_model(spark, sf, 1), 1, sentinel=False).select("item_id", "pos", F.col("model").alias("topic"), F.col("bits").alias("t"))
    whole = ppm.per_symbol(b, ["item_id"], ppm.train(t.withColumn("model", F.lit("all")), 1), 1, sentinel=False)
    return topic.join(whole.select("item_id", "pos", F.col("bits").alias("c")), ["item_id", "pos"])


@query(metrics_sql())
def divergence_metrics(spark, sf):
    """Cross-entropy under each topic's model, and its absolute and signed distance from the collection's model."""
    t, c = F.col("t"), F.col("c")
    w = topic_and_collection(spark, sf).groupBy("item_id", "topic")
    return w.agg(F.round(F.sum("t"), 4).alias("cross_entropy"), F.round(F.sum(F.abs(t - c)), 4).alias("topic_collection"), F.round(F.sum(t - c), 4).alias("topic_collection_signed"))


@query()
def document_metrics(spark, sf):
    """The metrics with a document's own model, which starts empty and learns: distance from the topic, radius of both
    around the collection, absolute and signed, and for each metric the topic that is least."""
    d, t, c = F.col("d"), F.col("t"), F.col("c")
    own = fold.adaptive_symbol_bits(table(spark, sf, "benchmark"), "item_id", order=1)
    w = topic_and_collection(spark, sf).join(own.select("item_id", "pos", F.col("bits").alias("d")), ["item_id", "pos"]).groupBy("item_id", "topic")
    names = ["cross_entropy", "document_topic", "topic_collection", "radius", "document_topic_signed", "topic_collection_signed", "radius_signed"]
    sums = [F.sum("t"), F.sum(F.abs(d - t)), F.sum(F.abs(t - c)), F.sum(F.abs(d + t - 2 * c)), F.sum(d - t), F.sum(t - c), F.sum(d + t - 2 * c)]
    m = w.agg(*[F.round(x, 4).alias(n) for n, x in zip(names, sums)])
    best = m.groupBy("item_id").agg(*[F.min_by("topic", F.struct(n, "topic")).alias(f"by_{n}") for n in names])
    return m.join(best, "item_id")


@query(f"""{_ID1}, m AS (SELECT lang, predicted FROM best JOIN documents USING (doc_id)), t AS (SELECT lang AS tag, count(*) AS n, count(*) FILTER (WHERE lang = predicted) AS h FROM m GROUP BY lang), p AS (SELECT predicted AS tag, count(*) AS n FROM m GROUP BY predicted)
SELECT count(*) AS models, round(avg(h / t.n), 6) AS macro_recall, round(avg(h / p.n), 6) AS macro_precision FROM t LEFT JOIN p USING (tag)""")
def lang_macro_averages(spark, sf):
    """Average recall and precision over the classes."""
    test, costs = lang_costs(spark, sf, 1)
    m = identify(costs, "doc_id").join(test.select("doc_id", "lang"), "doc_id").groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n"))
    t = m.groupBy(F.col("lang").alias("tag")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("lang") == F.col("predicted"), F.col("n")).otherwise(0)).alias("h"))
    p = m.groupBy(F.col("predicted").alias("tag")).agg(F.sum("n").alias("p"))
    return t.join(p, "tag", "left").agg(F.count(F.lit(1)).alias("models"), F.round(F.avg(F.col("h") / F.col("t")), 6).alias("macro_recall"), F.round(F.avg(F.col("h") / F.col("p")), 6).alias("macro_precision"))


_TYPES = r"SELECT DISTINCT unnest([x FOR x IN regexp_split_to_array(regexp_replace(text, '[^A-Za-z0-9_\x09-\x0D\x20]', '', 'g'), '[\x09-\x0D\x20]+') IF x <> '']) AS word FROM benchmark"


@query(f"{Q.codelengths(TURNS, f'SELECT word, word || chr(32) AS text FROM ({_TYPES})', 'word', 2)} SELECT word, model, round(bits, 4) AS bits FROM cl")
def word_type_bits(spark, sf):
    """How hard words are: cost of `word + space` with a trailing sentinel."""
    w = table(spark, sf, "benchmark").select(F.explode(T.plain_words(F.col("text"))).alias("word")).distinct().withColumn("text", F.concat("word", F.lit(" ")))
    return ppm.codelengths(w, "word", role_model(spark, sf, 2), 2).select("word", "model", F.round("bits", 4).alias("bits"))


@query(f"""{Q.codelengths(TURNS, f"SELECT word || '>' || cand AS key, cand AS text FROM (SELECT word, unnest([translate(word, 'aeiou', 'eioua'), translate(word, 'bdptckmn', 'dbtpkcnm'), reverse(word)]) AS cand FROM ({_TYPES})) WHERE cand <> word GROUP BY ALL", 'key', 2)},
r AS (SELECT split_part(key, '>', 1) AS word, split_part(key, '>', 2) AS fake, bits, row_number() OVER (PARTITION BY split_part(key, '>', 1) ORDER BY round(bits, 6), split_part(key, '>', 2)) AS r FROM cl WHERE model = 'user')
SELECT word, fake, round(bits, 4) AS bits FROM r WHERE r = 1""")
def fake_words(spark, sf):
    """The most plausible of the candidates made from a word by swapping vowels, swapping consonants and reversing."""
    w = table(spark, sf, "benchmark").select(F.explode(T.plain_words(F.col("text"))).alias("word")).distinct()
    c = w.select("word", F.explode(F.array(F.translate("word", "aeiou", "eioua"), F.translate("word", "bdptckmn", "dbtpkcnm"), F.reverse("word"))).alias("cand")).where("cand <> word").distinct()
    costs = ppm.codelengths(c.select(F.concat_ws(">", "word", "cand").alias("key"), F.col("cand").alias("text")), "key", role_model(spark, sf, 2).where("model = 'user'"), 2)
    best = costs.groupBy(F.split_part("key", F.lit(">"), F.lit(1)).alias("word")).agg(F.min(F.struct(F.round("bits", 6).alias("r"), F.split_part("key", F.lit(">"), F.lit(2)).alias("fake"), F.col("bits").alias("bits"))).alias("b"))
    return best.select("word", "b.fake", F.round("b.bits", 4).alias("bits"))


_REV = "SELECT item_id, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS text FROM benchmark"


@query(f"""WITH a AS ({Q.codelengths(TURNS, _ITEMS, 'item_id', 2)} SELECT * FROM cl WHERE model = 'user'), b AS ({Q.codelengths(TURNS, _REV, 'item_id', 2)} SELECT * FROM cl WHERE model = 'user')
SELECT a.item_id, round(a.bits, 4) AS bits, round(b.bits, 4) AS reversed_bits, a.bits <= b.bits AS plausible FROM a JOIN b ON b.item_id = a.item_id""")
def word_order_plausibility(spark, sf):
    """Cost of a text against the same words in reverse order."""
    counts = role_model(spark, sf, 2).where("model = 'user'")
    b = table(spark, sf, "benchmark")
    both = b.select("item_id", F.lit(0).alias("r"), "text").unionByName(b.select("item_id", F.lit(1).alias("r"), F.array_join(F.reverse(F.split("text", " ", -1)), " ").alias("text")))
    c = ppm.codelengths(both.select((F.col("item_id") * 2 + F.col("r")).alias("key"), "text"), "key", counts, 2)
    w = c.groupBy(F.floor(F.col("key") / 2).alias("item_id")).agg(F.max(F.when(F.col("key") % 2 == 0, F.col("bits"))).alias("a"), F.max(F.when(F.col("key") % 2 == 1, F.col("bits"))).alias("b"))
    return w.select("item_id", F.round("a", 4).alias("bits"), F.round("b", 4).alias("reversed_bits"), (F.col("a") <= F.col("b")).alias("plausible"))


@query(" UNION ALL ".join(f"SELECT * FROM ({Q.codelengths(TURNS, _ITEMS, 'item_id', k)} SELECT CAST({k} AS BIGINT) AS max_order, model, CAST(sum(symbols) AS BIGINT) AS symbols, round(sum(bits), 3) AS bits FROM cl GROUP BY model)" for k in (0, 1, 2)))
def bits_by_order(spark, sf):
    """Total cost of a collection for models of order 0, 1 and 2."""
    out = None
    for k in (0, 1, 2):
        c = ppm.codelengths(table(spark, sf, "benchmark"), "item_id", role_model(spark, sf, k), k)
        c = c.groupBy("model").agg(F.sum("symbols").alias("symbols"), F.round(F.sum("bits"), 3).alias("bits")).select(F.lit(k).cast("long").alias("max_order"), "model", "symbols", "bits")
        out = c if out is None else out.unionByName(c)
    return out


_PAR = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query(f"""{Q.codelengths(TURNS, _PAR, 'id', 1)}, t AS (SELECT id // 1000 AS conv_id, id % 1000 AS turn, bits FROM cl WHERE model = 'user'),
z AS (SELECT a.conv_id, a.bits AS x, b.bits AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)
SELECT CAST(round((x - y) / 100) AS BIGINT) AS difference, count(*) AS pairs, round(avg(x / y), 6) AS ratio FROM z GROUP BY ALL""")
def parallel_bits(spark, sf):
    """Parallel texts (question and answer): histogram of the cost difference in hundreds of bits, and mean ratio."""
    t = turns(spark, sf)
    c = ppm.codelengths(t.select(F.col("doc").alias("id"), "text"), "id", role_model(spark, sf, 1).where("model = 'user'"), 1)
    c = c.select(F.floor(F.col("id") / 1000).alias("conv_id"), (F.col("id") % 1000).alias("turn"), "bits")
    z = c.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("bits").alias("x")).join(c.withColumnRenamed("bits", "y"), ["conv_id", "turn"])
    return z.groupBy(F.round((F.col("x") - F.col("y")) / 100).cast("long").alias("difference")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("x") / F.col("y")), 6).alias("ratio"))


@query(f"""WITH {Q.symbols('te', _PAR, 'id', 2)}, tx AS (SELECT {Q.longest(2)} AS ctx, s FROM te) SELECT count(*) AS occurrences, count(DISTINCT ctx || s) AS scored, round(count(DISTINCT ctx || s) / count(*), 6) AS share FROM tx""")
def memo_share(spark, sf):
    """How much scoring distinct (context, symbol) pairs once saves."""
    g = ppm.gram_counts(turns(spark, sf), ["doc"], 2).groupBy("ctx", "s").agg(F.sum("n").alias("n"))
    g = g.groupBy(F.concat("ctx", "s").alias("g")).agg(F.sum("n").alias("n"))
    return g.agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("scored"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("share"))


_SPACES = "SELECT item_id, unnest(range(0, len(c))) AS i, unnest(c) AS s, side FROM (SELECT item_id, string_split(text, '') AS c, 'truth' AS side FROM benchmark UNION ALL SELECT item_id, string_split(replace(text, 'e ', 'e'), ''), 'output' FROM benchmark)"


@query(f"""WITH c AS ({_SPACES}), k AS (SELECT item_id, side, s, count(*) FILTER (WHERE s <> ' ') OVER (PARTITION BY item_id, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM c),
p AS (SELECT DISTINCT item_id, side, k FROM k WHERE s = ' '), t AS (SELECT item_id, count(*) AS n FROM p WHERE side = 'truth' GROUP BY ALL), o AS (SELECT item_id, count(*) AS n FROM p WHERE side = 'output' GROUP BY ALL),
m AS (SELECT a.item_id, count(*) AS n FROM p a JOIN p b ON a.item_id = b.item_id AND a.k = b.k AND a.side = 'truth' AND b.side = 'output' GROUP BY ALL)
SELECT t.item_id, round(100.0 * coalesce(m.n, 0) / t.n, 4) AS recall, round(100.0 * coalesce(m.n, 0) / o.n, 4) AS "precision" FROM t LEFT JOIN o ON o.item_id = t.item_id LEFT JOIN m ON m.item_id = t.item_id""")
def space_recall_precision(spark, sf):
    """Segmentation score: spaces of truth and output meet by the number of other symbols before them.

    A space's place is the length of the text before it without spaces: pieces between spaces give it, no window."""
    b = table(spark, sf, "benchmark")

    def places(df, text, side):
        pieces = F.split(text, " ", -1)
        ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)) + F.char_length(x))))
        return df.select("item_id", F.explode(F.array_distinct(ends)).alias("at"), F.lit(1).alias(side))

    t, o = places(b, F.col("text"), "t"), places(b, F.replace("text", F.lit("e "), F.lit("e")), "o")
    j = t.join(o, ["item_id", "at"], "full").groupBy("item_id").agg(F.sum(F.when(F.col("t").isNotNull() & F.col("o").isNotNull(), 1).otherwise(0)).alias("m"), F.count("t").alias("t"), F.count("o").alias("o")).where("t > 0")
    return j.select("item_id", F.round(100.0 * F.col("m") / F.col("t"), 4).alias("recall"), F.round(F.when(F.col("o") > 0, 100.0 * F.col("m") / F.col("o")), 4).alias("precision"))


_RANKS = "SELECT vec_id, CAST(len([x FOR x IN embedding IF x > embedding[label + 1]]) AS BIGINT) AS rank, len(embedding) AS n FROM embeddings WHERE label IS NOT NULL AND label < len(embedding)"


def ranks(spark, sf):
    e = table(spark, sf, "embeddings").where("label < size(embedding)")
    true = F.get("embedding", F.col("label"))
    return e.withColumn("__v", true).select("vec_id", F.size(F.filter("embedding", lambda x: x > F.col("__v"))).cast("long").alias("rank"), F.size("embedding").alias("n"))


@query(f"SELECT vec_id, rank FROM ({_RANKS})")
def token_ranks(spark, sf):
    """Rank of the true token among the sorted scores."""
    return ranks(spark, sf).select("vec_id", "rank")


@query(f"SELECT count(*) AS tokens, round(100.0 * avg(CASE WHEN rank = 0 THEN 1 ELSE 0 END), 6) AS top1, round(100.0 * avg(CASE WHEN rank BETWEEN 0 AND 15 THEN 1 ELSE 0 END), 6) AS top16 FROM ({_RANKS})")
def rank_hit_rates(spark, sf):
    """Share of ranks that are 0, and 0 to 15."""
    r = ranks(spark, sf)
    share = lambda c: F.round(100.0 * F.avg(F.when(c, 1).otherwise(0)), 6)
    return r.agg(F.count(F.lit(1)).alias("tokens"), share(F.col("rank") == 0).alias("top1"), share(F.col("rank").between(0, 15)).alias("top16"))


@query(f"SELECT CAST(rank * 100 // n AS BIGINT) AS bin, count(*) AS tokens, round(log10(count(*)), 6) AS log_tokens FROM ({_RANKS}) GROUP BY ALL")
def rank_histogram(spark, sf):
    """Histogram of ranks in a hundred bins, with logarithms."""
    return ranks(spark, sf).groupBy(F.floor(F.col("rank") * 100 / F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("tokens")).withColumn("log_tokens", F.round(F.log10("tokens"), 6))
