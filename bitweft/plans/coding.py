"""Queries that code, decode, rewrite or fold: checked by round trips and brute force, as SQL has no form for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitweft.operators import fold, ppm, rewrite, rules
from bitweft.plans.base import query
from bitweft.plans.models import turns
from bitweft.plans.scoring import identify
from bitweft.session import table
from bitweft.streaming import adaptive


@query()
def codec_report(spark, sf):
    """Classical codecs at level 9: sizes, ratio (compressed / original) and round trip of every page."""
    c = fold.compress(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    return c.withColumn("ratio", F.round(F.col("compressed_size") / F.col("original_size"), 6))


@query()
def ppm_codec(spark, sf):
    """Adaptive PPM arithmetic coding of every benchmark text, decoded again."""
    return fold.ppm_roundtrip(table(spark, sf, "benchmark"), "item_id").withColumn("bits", F.round("bits", 4))


@query()
def rank_codec(spark, sf):
    """Rank coding with a PPM ranker in blocks of 512, decoded again."""
    return fold.rank_codec(table(spark, sf, "benchmark"), "item_id")


@query()
def adaptive_bits(spark, sf):
    """Cost of each turn under a model that starts empty and learns."""
    t = turns(spark, sf).select("doc", "text")
    return fold.adaptive_bits(t, "doc", order=2).withColumn("bits", F.round("bits", 4))


@query()
def word_segmentation(spark, sf):
    """Spaces put back into benchmark texts by the cheapest path under a model of all turns."""
    models = rewrite.StaticModels.of(ppm.train(turns(spark, sf).withColumn("model", F.lit("all")), 2), 2)
    b = table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    return rewrite.segment_texts(b, "item_id", models, "all", beam=16).withColumn("bits", F.round("bits", 4))


def of_language_markup(spark, sf, order):
    d = table(spark, sf, "documents").select(F.col("lang").alias("model"), "text")
    return rewrite.markup_grams(turns(spark, sf).select("doc", "text"), "doc", ppm.train(d, order), order, ["de", "en", "es", "fr"])


@query()
def language_markup(spark, sf):
    """Which language's model each character of a turn is cheapest under, switching at spaces."""
    return of_language_markup(spark, sf, 1)


@query()
def sentence_alignment(spark, sf):
    """Length-based alignment of the lines of each question with those of its answer."""
    c = table(spark, sf, "conversations")
    q = c.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    p = q.join(c.select("conv_id", "turn", F.col("text").alias("a")), ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "q", "a")
    return rewrite.align_texts(p, "pair", "q", "a")


@query()
def event_streams(spark, sf):
    """Adaptive cost of each user's stream of event types (the batch form of the streaming model)."""
    return adaptive.fold(table(spark, sf, "events"), "user_id", "event_id", "event_type", 5).withColumn("bits", F.round("bits", 6))


def all_turns(spark, sf, order=2, alphabet=65536, change=None):
    """One model of all turns, held for a fold; `change` is applied to their texts first."""
    t = turns(spark, sf).withColumn("model", F.lit("all"))
    return rewrite.StaticModels.of(ppm.train(t if change is None else t.withColumn("text", change(F.col("text"))), order), order, alphabet)


@query()
def static_codec(spark, sf):
    """Static PPM codes of every benchmark text under a model of all turns, and what they decode to again."""
    m = all_turns(spark, sf, alphabet=0x110000)
    b = table(spark, sf, "benchmark").select("item_id", "text")
    coded = rewrite.encode_texts(b, "item_id", m, "all")
    back = rewrite.decode_texts(coded, "item_id", m, "all").withColumnRenamed("text", "decoded")
    out = b.join(coded, "item_id").join(back, "item_id")
    return out.select("item_id", F.octet_length("text").cast("long").alias("original_size"), F.octet_length("code").cast("long").alias("compressed_size"), F.sha2("code", 256).alias("code_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored"))


@query()
def number_codec(spark, sf):
    """Adaptive codes of each order's quantities in the order of its lines, decoded again; an order has few lines."""
    return fold.number_roundtrip(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", alphabet=1 << 20)


def without_spaces(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("")).alias("text"))


def rounded(df):
    return df.withColumn("bits", F.round("bits", 4))


@query()
def rule_segmentation(spark, sf):
    """word_segmentation as a rule set: keep a character, or put a space behind it."""
    return rounded(rules.rewrite_texts(without_spaces(spark, sf), "item_id", rules.segmentation(), all_turns(spark, sf), ["all"], beam=16))


@query()
def rule_segmentation_before(spark, sf):
    """The variant that puts spaces before letters and digits only."""
    return rounded(rules.rewrite_texts(without_spaces(spark, sf), "item_id", rules.segmentation(True, True), all_turns(spark, sf), ["all"], beam=16))


@query()
def rule_playfair(spark, sf):
    """The variant that also takes out the x that a cipher put behind o and before e."""
    padded = without_spaces(spark, sf).withColumn("text", F.regexp_replace(F.lower("text"), "oo", "oxo"))
    return rounded(rules.rewrite_texts(padded, "item_id", rules.playfair(), all_turns(spark, sf), ["all"], beam=16))


@query()
def rule_tagging(spark, sf):
    """Every space of a lower-cased benchmark text becomes one of two tags: before a capital or not, as in the tagged turns."""
    tagged = lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, " (?=[A-Z])", "\x02"), " ", "\x01"))
    b = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("text"))
    return rounded(rules.rewrite_texts(b, "item_id", rules.tagging("\x01\x02"), all_turns(spark, sf, change=tagged), ["all"], beam=16))


@query()
def rule_markup_words(spark, sf):
    """Language markup as a rule set: another language's model may take over behind a space, at 12 bits."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("model"), "text")
    models = rewrite.StaticModels.of(ppm.train(d, 1), 1)
    names = ["de", "en", "es", "fr"]
    return rounded(rules.rewrite_texts(table(spark, sf, "benchmark"), "item_id", rules.switching(names, 12.0, True), models, names))


@query()
def role_id_with_dynamic(spark, sf):
    """Identification among the roles' models and one that starts empty and learns; each half of the conversations
    trains the models of the other, so every turn is scored."""
    t = turns(spark, sf)
    fresh = fold.adaptive_bits(t, "doc", order=1).select("doc", F.lit("<new>").alias("model"), "bits")
    half = [t.where(F.col("conv_id") % 2 == h) for h in (0, 1)]
    fixed = [ppm.codelengths(half[h].select("doc", "text"), "doc", ppm.train(half[1 - h], 1), 1) for h in (0, 1)]
    costs = fixed[0].unionByName(fixed[1])
    every = costs.select("doc", "model", "bits", "symbols").unionByName(fresh.withColumn("symbols", F.lit(None).cast(costs.schema["symbols"].dataType)))
    return rounded(identify(every, "doc").drop("symbols").join(t.select("doc", F.col("model").alias("role")), "doc"))
