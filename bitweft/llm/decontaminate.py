"""Benchmark decontamination by template canonicalisation.

Numbers, names and units in benchmark items and documents become typed placeholders. Windows of five
canonical words of the items are the index; windows of the documents' whole texts meet it by their hash. A
document is contaminated by an item if at least `least` of the item's windows stand in it. Where an item has
slots (placeholders), the values that the document puts into them must be consistent: one value of the item
always corresponds to one value of the document, so re-parameterised copies are caught and texts that only
share a pattern of placeholders are not. All DataFrame operations.

Documents that hold less than `least` of the windows are compared with the item word by word in the places of the
windows they hold. They are contaminated too by a passage, PASSAGE equal words in a row whatever their share of the
item, and by an edited copy, EDITED of the item's words in their places, where insertions and deletions may move
places by up to MOVED words. Slots in the passage (the copy) must be consistent. A copy that keeps no indexed window
at all is not seen.

Placeholders: a name is a capitalised word in the middle of a sentence; a number is a run of digits with
inner points or commas; a unit is a word of UNITS after a number. All else is lower-cased without signs.

Edge cases: null or empty text matches nothing; a text (or item) of less than five words is one window;
windows with less than two ordinary words are not indexed, an item without any matches documents that hold its words
in a row with the same values (from five words on); rows with one id are one document; rows without id are reported
clean; each text of an item id is matched on its own; repeated items are one; texts of any length are handled; an empty table on either side
works; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from bitweft.session import Workspace, pick, small, table

WORDS = 5

#: Equal words in a row that are a passage; share of an item's words that is an edited copy, and how far places may move.
PASSAGE, EDITED, MOVED = 13, 0.8, 3

#: Index windows up to this count go to every executor; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

#: Private-use characters stand for the placeholders; they are no letters, so no word of a text becomes one.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"

UNITS = "km kg cm mm mg ml kw mw gb mb kb hz khz mhz ghz lb lbs oz ft mph kph m g l s h min sec hours hour minutes minute seconds second days day weeks week months month years year meters metres meter metre kilometers kilometres miles mile inches inch feet foot liters litres grams kilograms pounds dollars dollar euros euro cents cent percent degrees degree".split()

_WHITE = " \t\n\x0b\x0c\r"


def words(text: Column, typed: bool = True) -> Column:
    """Canonical words, with placeholders if typed, else with the values in their places (same count, same places)."""
    if typed:
        text = F.regexp_replace(text, r"\p{Lu}(?<=[^\s.!?:;][ \t].)[\p{L}'’-]*", NAME)
        text = F.regexp_replace(text, r"\p{Nd}+(?:[.,]\p{Nd}+)*+", NUMBER)
        text = F.regexp_replace(text, rf"{NUMBER}([ \t]?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}])", NUMBER + "$1" + UNIT)
        text = F.regexp_replace(text, rf"[^\p{{L}}{NAME}-{UNIT}\s]+", "")
    else:
        text = F.regexp_replace(text, r"[^\p{L}\p{Nd}\s]+", "")
    text = F.btrim(F.lower(text), F.lit(_WHITE))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\s+", -1))


def is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}-{UNIT}]")


def window_rows(df: DataFrame) -> DataFrame:
    """For df(id, words): id, at, hash, literals of every window (of all words if they are less than WORDS)."""
    n = F.greatest(F.size("words") - (WORDS - 1), F.least(F.size("words"), F.lit(1)))
    zipped = F.arrays_zip(*[F.slice("words", k + 1, n).alias(f"w{k}") for k in range(WORDS)])
    rows = df.select("id", F.posexplode(zipped).alias("at", "w"))
    literal = sum((F.when(is_slot(F.col(f"w.w{k}")), 0).when(F.col(f"w.w{k}").isNotNull(), 1).otherwise(0) for k in range(WORDS)), F.lit(0))
    return rows.select("id", "at", F.xxhash64(*[f"w.w{k}" for k in range(WORDS)]).alias("hash"), literal.alias("literals"))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, containment: every document and item that it is contaminated by."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    d = pick(docs, id=id_col, text=text_col).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    b = pick(benchmark, item=item_col, text=item_text_col).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    # Every text of an item is an item of its own until the end: (item, digest of its text).
    b = b.select(F.struct("item", F.md5("text").alias("text")).alias("item"), "text")
    items = ws.put(b.groupBy("item").agg(F.first("text").alias("text")).select("item", words(F.col("text")).alias("words"), words(F.col("text"), typed=False).alias("values")), "items")
    index = window_rows(items.select(F.col("item").alias("id"), "words")).where("literals >= 2")
    index = index.select(F.col("id").alias("item"), F.col("at").alias("t"), "hash")
    index = ws.put(index.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("item"))), "index")
    rows = window_rows(d.select("id", words(F.col("text")).alias("words"))).select("id", F.col("at").alias("p"), "hash")
    met = rows.join(small(index, BROADCAST_WINDOWS), "hash")
    # Which windows of the item the document holds on each relative place.
    per_place = met.groupBy("id", "item", (F.col("p") - F.col("t")).alias("shift")).agg(F.collect_set("t").alias("ts"), F.max("of").alias("of"))
    places = F.collect_list(F.struct(F.col("shift").alias("s"), F.col("ts").alias("ts")))
    per_item = per_place.groupBy("id", "item").agg(places.alias("places"), F.max("of").alias("of"))
    per_item = per_item.withColumn("ts", F.array_distinct(F.flatten("places.ts"))).withColumn("shifts", F.col("places.s"))
    per_item = ws.put(per_item.select("id", "item", "places", "shifts", "of", (F.size("ts") / F.col("of")).alias("containment")), "met")
    found = per_item.where(F.col("containment") >= least)
    slotted = items.select("item", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: is_slot(F.element_at("words", i + 1))).alias("slots"), "words", "values").where(F.size("words") > 0).where(F.size("slots") > 0)
    to_check = ws.put(found.join(slotted, "item"), "slots")
    pairs = ["id", "item", "containment"]
    whole = found.join(to_check.select("id", "item"), ["id", "item"], "left_anti").select(*pairs)
    if to_check.limit(1).count():
        whole = ws.put(whole.unionByName(consistent(d, to_check, least)), "whole")
    rest = ws.put(per_item.join(whole.select("id", "item"), ["id", "item"], "left_anti").select("id", "item", "shifts", "containment"), "rest")
    if rest.limit(1).count():
        whole = whole.unionByName(partial(d, rest, items))
    bare = ws.put(items.join(index.select("item").distinct(), "item", "left_anti").where(F.size("values") >= WORDS).select("item", "values"), "bare")
    if bare.limit(1).count():
        whole = whole.unionByName(verbatim(d, bare))
    return whole.groupBy("id", F.col("item.item").alias("item")).agg(F.max("containment").alias("containment"))


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For items(item, values) that have no indexed window (numbers and names only): the documents where their words stand
    in a row with the same values. Windows of the values meet by hash, the whole sequence is then compared."""
    rows = window_rows(docs.select("id", words(F.col("text"), typed=False).alias("words"))).select("id", F.col("at").alias("p"), "hash")
    first = window_rows(items.select(F.col("item").alias("id"), F.col("values").alias("words"))).where("at = 0").select(F.col("id").alias("item"), "hash")
    met = rows.join(small(first, BROADCAST_WINDOWS), "hash").groupBy("id", "item").agg(F.collect_set("p").alias("ps"))
    text = docs.select("id", words(F.col("text"), typed=False).alias("dv"))
    both = met.join(small(items, 50_000), "item").join(text, "id")
    same = F.exists("ps", lambda p: F.slice("dv", p + 1, F.size("values")) == F.col("values"))
    return both.where(same).groupBy("id", "item").agg(F.lit(1.0).alias("containment"))


def partial(docs: DataFrame, met: DataFrame, items: DataFrame) -> DataFrame:
    """Those of met(id, item, shifts, containment) where the document holds a passage or an edited copy of the item."""
    text = docs.join(small(met.select(F.col("id").alias("__id")).distinct()), F.col("id") == F.col("__id"), "left_semi")
    text = text.select("id", words(F.col("text")).alias("dw"), words(F.col("text"), typed=False).alias("dv"))
    both = text.join(small(met.join(small(items, 50_000), "item"), 50_000), "id")
    n = F.size("words")
    word = lambda i: F.get("words", i)
    same = lambda i, shift: F.coalesce(F.get("dw", i + shift) == word(i), F.lit(False))
    places = F.sequence(F.lit(0), n - 1)

    def fit(pairs: Column) -> Column:
        pairs = F.array_distinct(pairs)
        return F.aggregate(F.array(pairs), F.lit(True), lambda _, p: F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["a"]))))

    def filled(slots: Column, shift_of) -> Column:
        return fit(F.transform(slots, lambda i: F.struct(F.get("values", i).alias("a"), F.get("dv", i + shift_of(i)).alias("b"))))

    def place(s: Column) -> Column:
        near = F.filter(F.array(*[s + k for k in sorted(range(-MOVED, MOVED + 1), key=abs)]), lambda x: F.array_contains("shifts", x))
        breaks = F.concat(F.array(F.lit(-1)), F.filter(places, lambda i: ~same(i, s)), F.array(n))
        copy = F.transform(F.array(near), lambda near: F.transform(places, lambda i: F.get(F.filter(near, lambda x: same(i, x)), F.lit(0))))[0]
        return F.struct(s.alias("s"), breaks.alias("breaks"), copy.alias("copy"))

    def passage(a: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(a["breaks"]) - 1), lambda k: F.get(a["breaks"], k) - F.get(a["breaks"], k - 1) > PASSAGE)
        inside = lambda k: F.filter("slots", lambda i: (i > F.get(a["breaks"], k - 1)) & (i < F.get(a["breaks"], k)))
        return F.exists(ends, lambda k: filled(inside(k), lambda i: a["s"]))

    def edited(a: Column) -> Column:
        enough = F.size(F.filter(a["copy"], lambda x: x.isNotNull())) >= n * EDITED
        return enough & filled(F.filter("slots", lambda i: F.get(a["copy"], i).isNotNull()), lambda i: F.get(a["copy"], i))

    both = both.where(n >= WORDS).withColumn("slots", F.filter(places, lambda i: is_slot(word(i))))
    ok = F.exists(F.transform("shifts", place), lambda a: passage(a) | edited(a))
    return both.where(ok).groupBy("id", "item").agg(F.max("containment").alias("containment"))


def consistent(docs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Those of found(id, item, places, of, containment, slots, words, values) that hold at least `least` of the windows in
    some alignment with consistently filled slots, or whose best alignment is consistent if none holds so many.

    An alignment is a relative place and those up to MOVED words beside it, as words may be put in or left out. Slots
    count where they stand in or beside a window that is held at that place."""
    text = docs.join(small(found.select(F.col("id").alias("__id")).distinct()), F.col("id") == F.col("__id"), "left_semi")
    text = text.select("id", words(F.col("text")).alias("dw"), words(F.col("text"), typed=False).alias("dv"))
    both = text.join(small(found, 50_000), "id")
    beside = lambda a: F.filter("places", lambda b: F.abs(a["s"] - b["s"]) <= MOVED)
    held = F.transform("places", lambda a: F.struct(F.size(F.array_distinct(F.flatten(F.transform(beside(a), lambda b: b["ts"])))).alias("n"), beside(a).alias("near")))
    both = both.withColumn("held", held).withColumn("most", F.array_max(F.transform("held", lambda h: h["n"])))

    def pairs(b: Column) -> Column:
        inside = F.filter("slots", lambda i: (F.get("dw", i + b["s"]) == F.get("words", i)) & F.exists(b["ts"], lambda t: i.between(t - (WORDS - 1), t + 2 * (WORDS - 1))))
        return F.transform(inside, lambda i: F.struct(F.get("values", i).alias("a"), F.get("dv", i + b["s"]).alias("b")))

    def fits(h: Column) -> Column:
        every = F.array_distinct(F.flatten(F.transform(h["near"], pairs)))
        return F.size(every) == F.size(F.array_distinct(F.transform(every, lambda x: x["a"])))

    enough = lambda h: (h["n"] >= F.col("of") * least) | (h["n"] == F.col("most"))
    return both.where(F.exists("held", lambda h: enough(h) & fits(h))).groupBy("id", "item").agg(F.max("containment").alias("containment"))


def verdicts(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document: id, kept, n_items, items (sorted list of item ids), containment (highest, else 0)."""
    found = matches(docs, benchmark, least, id_col, text_col, item_col, item_text_col)
    by_id = found.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("containment").alias("containment"))
    ids = pick(docs, id=id_col)
    out = ids.join(by_id.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    none = F.array().cast(by_id.schema["items"].dataType)
    return out.select("id", F.col("items").isNull().alias("kept"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return v.select(F.col("id").alias("doc_id"), "kept", "n_items", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "containment")
