"""Sources, sinks and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bitweft.functions import text as T
from bitweft.plans.base import query
from bitweft.session import Workspace, table
from bitweft.sources import models

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("""SELECT item_id, CAST(unnest(range(0, len(s))) AS BIGINT) AS pos, CAST(unnest(s) AS BIGINT) AS sym FROM (
  SELECT item_id, list_append([unicode(c) FOR c IN string_split(text, '')], 2147483646) AS s FROM benchmark)""")
def text_symbols(spark, sf):
    """Loaded texts: every symbol with its place, and the trailing sentinel."""
    t = table(spark, sf, "benchmark").select("item_id", F.posexplode(T.symbols(F.col("text"))).alias("pos", "sym"))
    return t.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("sym").cast("long").alias("sym"))


@query("""SELECT page_id, CAST(unnest(range(0, len(n))) AS BIGINT) AS pos, CAST(unnest(n) AS BIGINT) AS number FROM (
  SELECT page_id, regexp_extract_all(url, '[0-9]+') AS n FROM pages) WHERE len(n) > 0""")
def number_stream(spark, sf):
    """Number streams: unsigned decimals in a text, in order."""
    n = F.split(F.trim(F.regexp_replace("url", "[^0-9]+", " ")), " +")
    t = table(spark, sf, "pages").select("page_id", F.posexplode(F.filter(n, lambda x: x != "")).alias("pos", "number"))
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("number").cast("long").alias("number"))


@query(r"""SELECT conv_id, turn, array_to_string([CASE WHEN c = '\' THEN '\\' WHEN regexp_matches(c, '^[\x20-\x7E\n\t]$') THEN c ELSE '\' || CAST(unicode(c) AS VARCHAR) || '\' END FOR c IN string_split(text, '')], '') AS escaped, TRUE AS restored FROM conversations""")
def escaped_text(spark, sf):
    r"""Escaped form of a text (\number\ for other symbols) and whether reading it gives the text back."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", T.escape(F.col("text")).alias("escaped"))
    return t.select("conv_id", "turn", "escaped", (T.unescape(F.col("escaped")) == F.col("text")).alias("restored"))


@query("""SELECT doc_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS line, CAST(unnest([length(x) FOR x IN l]) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def text_lines(spark, sf):
    """Lines of each document with their number and length."""
    t = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "x"))
    return t.select("doc_id", F.col("line").cast("long").alias("line"), F.char_length("x").cast("long").alias("n_chars"))


@query("SELECT item_id, substr(text, 1, 80) AS head, CAST(length(substr(text, 1, 80)) AS BIGINT) AS n_chars FROM benchmark")
def read_at_most(spark, sf):
    """At most 80 characters of each text: the reader's own limit."""
    return table(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 80).alias("head"), F.char_length(F.substring("text", 1, 80)).cast("long").alias("n_chars"))


@query("SELECT DISTINCT lang AS tag, source AS path FROM documents")
def model_manifest(spark, sf):
    """Manifest lines `tag path`, written as text and read by the manifest source."""
    lines = table(spark, sf, "documents").select(F.concat_ws(" ", "lang", "source").alias("value")).distinct()
    path = Workspace(spark, "manifest").path("lines")
    lines.write.text(path)
    return models.manifest(spark, path)


@query(r"""SELECT doc_id, CAST(i // 128 AS BIGINT) AS block, count(*) AS tokens, min(w) AS least FROM (
  SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '[\x09-\x0D\x20]+') IF x <> ''] AS ws FROM documents)) GROUP BY ALL""")
def token_blocks(spark, sf):
    """Fixed blocks of 128 tokens, as language models are trained on."""
    t = table(spark, sf, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("i", "w"))
    return t.groupBy("doc_id", F.floor(F.col("i") / 128).alias("block")).agg(F.count(F.lit(1)).alias("tokens"), F.min("w").alias("least"))


@query("""WITH r AS (SELECT role, dense_rank() OVER (ORDER BY role) - 1 AS label FROM (SELECT DISTINCT role FROM conversations)),
s AS (SELECT role, unnest([unicode(c) FOR c IN string_split(text, '')]) AS sym FROM conversations)
SELECT role, CAST(label AS BIGINT) AS label, count(*) AS symbols, CAST(sum(sym + 256 * label) AS BIGINT) AS checksum, CAST(max(sym + 256 * label) AS BIGINT) AS largest FROM s JOIN r USING (role) GROUP BY ALL""")
def label_symbols(spark, sf):
    """Labelled symbols: sym + 256 * label, the label being the rank of the text's class."""
    c = table(spark, sf, "conversations")
    roles = c.select("role").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("role")) - 1).cast("long"))
    s = c.select("role", F.explode(T.symbols(F.col("text"), sentinel=False)).alias("sym")).join(F.broadcast(roles), "role")
    x = F.col("sym") + 256 * F.col("label")
    return s.groupBy("role", "label").agg(F.count(F.lit(1)).alias("symbols"), F.sum(x).alias("checksum"), F.max(x).alias("largest"))


@query("""SELECT o_orderpriority AS src, o_orderstatus AS dst, round(-log2(n / sum(n) OVER (PARTITION BY o_orderpriority)), 6) AS bits FROM (
  SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)""")
def rewrite_rules(spark, sf):
    """Rule lines `freq total src -> dst`, written and parsed: cost is -log2(freq / total)."""
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    lines = n.select(F.format_string("%d %d %s -> %s", "n", F.sum("n").over(Window.partitionBy("o_orderpriority")), "o_orderpriority", "o_orderstatus").alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(\d+) (\d+) (.*?) -> (.*)$", k)
    return lines.select(part(3).alias("src"), part(4).alias("dst"), F.round(-F.log2(part(1).cast("double") / part(2).cast("double")), 6).alias("bits"))


_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS \"n_{n}\"" for n, p in T.CLASSES.items())


@query(f"SELECT doc_id, {_COUNTS} FROM documents")
def char_classes(spark, sf):
    """How many symbols of each class a document has."""
    d = table(spark, sf, "documents").select("doc_id", T.count_classes(F.col("text")).alias("n"))
    return d.select("doc_id", *[F.col(f"n.{n}").alias(f"n_{n}") for n in T.CLASSES])


@query(f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_symbols, CAST(length(text) + 1 AS BIGINT) AS with_sentinel, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(translate(text, '{_UP}', '{_LOW}')) AS lower_md5, md5(translate(text, '{_LOW}', '{_UP}')) AS upper_md5 FROM documents""")
def text_length_case(spark, sf):
    """Lengths with and without sentinel, in bytes, and ASCII case mapping."""
    return table(spark, sf, "documents").select("doc_id", F.char_length("text").cast("long").alias("n_symbols"), (F.char_length("text") + 1).cast("long").alias("with_sentinel"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.translate("text", _UP, _LOW)).alias("lower_md5"), F.md5(F.translate("text", _LOW, _UP)).alias("upper_md5"))


@query("""SELECT item_id, CAST(strpos(text, 'e') - 1 AS BIGINT) AS first_e, CAST(CASE WHEN contains(text, 'e') THEN length(text) - strpos(reverse(text), 'e') ELSE -1 END AS BIGINT) AS last_e, CAST(strpos(text, 'the ') - 1 AS BIGINT) AS find_the, replace(text, 'th', '') AS cut,
 substr(text, 6, 10) AS part, substr(text, 1, 3) || '***' || substr(text, 7) AS overlaid, text || ' ' || substr(text, 1, 5) AS joined FROM benchmark""")
def text_positions(spark, sf):
    """First and last place of a symbol, find, cut out, extract, overwrite and append (-1: not found)."""
    t = F.col("text")
    last = F.when(F.instr("text", "e") > 0, F.char_length("text") - F.instr(F.reverse("text"), "e")).otherwise(-1)
    return table(spark, sf, "benchmark").select("item_id", (F.instr("text", "e") - 1).cast("long").alias("first_e"), last.cast("long").alias("last_e"), (F.instr("text", "the ") - 1).cast("long").alias("find_the"), F.replace("text", F.lit("th"), F.lit("")).alias("cut"), F.substring("text", 6, 10).alias("part"), F.overlay("text", F.lit("***"), 4, 3).alias("overlaid"), F.concat(t, F.lit(" "), F.substring("text", 1, 5)).alias("joined"))


@query("""SELECT item_id, CAST(CASE WHEN text < p THEN -1 WHEN text > p THEN 1 ELSE 0 END AS BIGINT) AS compared, starts_with(text, 'Th') AS th FROM (
  SELECT item_id, text, lag(text) OVER (ORDER BY item_id) AS p FROM benchmark) WHERE p IS NOT NULL""")
def text_compare(spark, sf):
    """Three-way comparison with the item before, joined on its place, and a prefix test."""
    b = table(spark, sf, "benchmark")
    p = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("p"))
    way = F.when(F.col("text") < F.col("p"), -1).when(F.col("text") > F.col("p"), 1).otherwise(0)
    return b.join(p, "item_id").select("item_id", way.cast("long").alias("compared"), F.startswith("text", F.lit("Th")).alias("th"))


@query("""SELECT conv_id, turn, CAST(unnest(range(0, len(p))) AS BIGINT) AS pos, unnest([regexp_extract(x, '^([^A-Za-z0-9]*)', 1) FOR x IN p]) AS nonword, unnest([regexp_extract(x, '([A-Za-z0-9]*)$', 1) FOR x IN p]) AS word FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '([^A-Za-z0-9]*[A-Za-z0-9]+|[^A-Za-z0-9]+$)') AS p FROM conversations)""")
def nonword_word_pairs(spark, sf):
    """The (nonword, word) tokenizer."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.nonword_words(F.col("text"))).alias("pos", "p"))
    return t.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "p.nonword", "p.word")


@query(r"""SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(regexp_replace(text, '[^A-Za-z0-9_\x09-\x0D\x20]', '', 'g'), '[\x09-\x0D\x20]+') IF x <> '']) AS word FROM documents) GROUP BY word""")
def distinct_words(spark, sf):
    """Distinct words without punctuation, with their counts."""
    t = table(spark, sf, "documents").select("doc_id", F.explode(T.plain_words(F.col("text"))).alias("word"))
    per = t.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(r"""SELECT lang, count(*) AS docs, CAST(sum(length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) AS BIGINT) AS replaced, min(md5(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'))) AS least FROM documents WHERE length(text) >= 500 GROUP BY lang""")
def ascii_long_texts(spark, sf):
    """ASCII with replacement, of texts of a least length (the classifier's -L)."""
    d = table(spark, sf, "documents").where(F.char_length("text") >= 500)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.count_class(F.col("text"), "ascii") * -1 + F.char_length("text")).alias("replaced"), F.min(F.md5(T.to_ascii(F.col("text")))).alias("least"))


@query("SELECT p_partkey, round(CASE WHEN p_size - 1 = 0 AND p_size = 50 THEN 0 ELSE -log2((p_size - (p_size - 1)) / 50) END + CASE WHEN p_size = 50 THEN 0 ELSE -log2(p_size / 50) END, 6) AS bits FROM part")
def range_costs(spark, sf):
    """Costs of coding ranges: one symbol's, and an escape's over the rest (the whole range is free)."""
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.round(T.range_bits(s - 1, s, F.lit(50)) + T.range_bits(F.lit(0), s, F.lit(50)), 6).alias("bits"))


@query("""WITH t AS (SELECT doc_id, text || repeat(chr(10), CAST(doc_id % 3 AS INTEGER)) AS text FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END) AS last_off_md5, CAST(length(text) - len(string_split(text, chr(10))) + 1 AS BIGINT) AS without_eoln FROM t""")
def eoln_handling(spark, sf):
    """Deleting the last line feed of texts that end in none, one or two, and deleting all of them."""
    t = table(spark, sf, "documents").select("doc_id", F.concat("text", F.repeat(F.lit("\n"), (F.col("doc_id") % 3).cast("int"))).alias("text"))
    return t.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5(T.drop_last_eoln(F.col("text"))).alias("last_off_md5"), F.char_length(T.drop_eolns(F.col("text"))).cast("long").alias("without_eoln"))


@query("SELECT item_id, CAST(CAST(regexp_extract(printf('%d:%s', item_id, text), '^([0-9]+):', 1) AS BIGINT) AS BIGINT) AS number, printf('%d:%s', item_id, text) AS line FROM benchmark")
def print_and_scan(spark, sf):
    """Formatted printing of numbers and texts, and scanning them back."""
    t = table(spark, sf, "benchmark").select("item_id", F.format_string("%d:%s", "item_id", "text").alias("line"))
    return t.select("item_id", F.regexp_extract("line", "^([0-9]+):", 1).cast("long").alias("number"), "line")
