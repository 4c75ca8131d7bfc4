"""Secret scan: fixed patterns plus sliding-window Shannon entropy per character class, with an allow list.

All DataFrame operations. Places come from one pass each of split and regexp_extract_all with the same
pattern: the lengths of the pieces between matches and of the matches add up to the places (code points, end
exclusive). Candidate strings for the entropy scan are runs of [A-Za-z0-9+/_=-] with at least WINDOW
characters that hold a digit and a letter. A window slides over each; the counts of its characters, and the
sum of c*log2(c) over them, are updated by the character that enters and the one that leaves. A candidate
whose highest window entropy reaches its class's limit is a secret, unless the allow list knows its form.

Edge cases: null or empty text has no spans (digest of the empty string); repeated rows and null ids give a
row each; an empty table gives an empty result; extra columns are ignored; very long candidates are scanned
whole, in linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.session import pick, table

#: Fixed values of the contract: kind -> pattern, in the order in which kinds are listed. Runs that are too
#: short cannot be part of a longer match of hex or access, so their least lengths are in the pattern;
#: assign drops short matches afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN = 6
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Character class -> pattern of the whole candidate, entropy limit in bits per character of a window.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9)]

#: Forms that are no secrets: UUIDs, dates and counters joined by signs, paths and slugs of plain words, placeholders.
#: Repeated groups are possessive: they loop instead of recursing, so a slug of any length is matched in constant stack.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*+[/_=-]*$",
    r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|abcdef0123",
]

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, found) of all leftmost non-overlapping matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.zip_with(gaps, found, lambda g, f: F.struct(g.alias("g"), f.alias("f")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def merge(acc, x):
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(F.char_length(x["f"]), F.lit(0)).cast("long")
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["f"].alias("found"))
        return F.struct(end.alias("at"), F.when(x["f"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(step, start, merge, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of the windows of `window` characters of a string."""
    place = lambda c: F.instr(F.lit(_ALPHABET), c)
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(place(c)))
    codes = F.filter(codes, lambda c: c > 0)
    # x*log2(x) for counts 0..window: the sum over a window's characters changes by differences of these.
    xlog = [0.0] + [x * math.log2(x) for x in range(1, window + 1)]
    table_ = F.array(*[F.lit(x) for x in xlog])
    size = len(_ALPHABET) + 1
    zero = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
    # The character that leaves stands `window` places before: a shifted copy, not a look-up, which would cost the whole text each.
    left = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes))
    pairs = F.transform(F.arrays_zip(codes.alias("new"), left.alias("old")), lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), i.alias("i")))

    def slide(acc, x):
        n_new, n_old = F.element_at(acc["n"], x["new"]), F.when(x["old"] > 0, F.element_at(acc["n"], x["old"])).otherwise(F.lit(0))
        same = x["new"] == x["old"]
        grown = F.element_at(table_, n_new + 2) - F.element_at(table_, n_new + 1)
        shrunk = F.when(n_old > 0, F.element_at(table_, n_old + 1) - F.element_at(table_, n_old)).otherwise(F.lit(0.0))
        s = F.when(same, acc["s"]).otherwise(acc["s"] + grown - shrunk)
        counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda c, j: c + F.when(j + 1 == x["new"], 1).otherwise(0) - F.when((j + 1 == x["old"]) & (x["old"] > 0), 1).otherwise(0)))
        return F.struct(counts.alias("n"), s.alias("s"), F.when(x["i"] >= window - 1, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

    lowest = F.aggregate(pairs, zero, slide, lambda acc: acc["least"])
    return F.lit(math.log2(window)) - lowest / F.lit(float(window))


def entropy_spans(text: Column) -> Column:
    """Candidates whose window entropy reaches the limit of their character class and that no allow form fits."""

    def secret(x):
        t = x["found"]
        mixed = t.rlike("[0-9]") & t.rlike("[A-Za-z]")
        limit = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            limit = F.when(t.rlike(pattern), F.lit(bits)).otherwise(limit)
        allowed = F.lit(False)
        for form in ALLOW:
            allowed = allowed | t.rlike(form)
        return F.when(~mixed | allowed, F.lit(False)).otherwise(window_entropy(t) >= limit)

    return F.filter(spans(text, CANDIDATE, KINDS.index("entropy")), secret)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id and spans (start, kind as its number in KINDS, end, found), by start, then kind."""
    d = pick(docs, id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(spans(text, ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 1)) >= LEAST_ASSIGN)
    every = F.concat(assigned, spans(text, ACCESS, 1), spans(text, HEX, 2), entropy_spans(text))
    return d.select("id", F.array_sort(every).alias("spans"))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
