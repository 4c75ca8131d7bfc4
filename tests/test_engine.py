"""Hand-made fixtures, invariants, round trips and brute force for the engine's own operators."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitweft.functions import text as T
from bitweft.operators import fold, grams, ppm, rewrite, rules, word_models, words
from bitweft.plans import registry
from bitweft.plans.scoring import identify
from bitweft.sources import models
from bitweft.streaming import adaptive

S = T.SENTINEL


@pytest.fixture(scope="module")
def abab(spark):
    return ppm.train(spark.createDataFrame([("m", "abab")], "model string, text string"), 1).cache()


def test_counts_of_abab(abab):
    got = {(r.ctx, r.s): r.cnt for r in abab.collect()}
    assert got == {("", "a"): 3, ("", "b"): 1, ("", S): 1, ("a", "b"): 3, ("b", "a"): 1, ("b", S): 1}


def test_costs_of_abab(spark, abab):
    t = spark.createDataFrame([("ab",), ("c",)], "text string")
    c = {(r.text, r.pos): r.bits for r in ppm.per_symbol(t.withColumn("text", F.col("text")).select("text", F.col("text").alias("t")), ["text"], abab, 1, 256, text="t").collect()}
    assert c["ab", 0] + c["ab", 1] + c["ab", 2] == pytest.approx(-math.log2(3 / 8) - math.log2(3 / 4) + 2, abs=1e-9)
    assert c["c", 0] == pytest.approx(-math.log2(3 / 8) + math.log2(255), abs=1e-9)
    mass = 5 / 8 + 3 / 8 * 254 / 255
    known = ppm.distribution(abab, spark.createDataFrame([("m", "")], "model string, ctx string"), 1, 256).collect()
    assert sum(2**-r.bits for r in known) + 254 * 2 ** -c["c", 0] == pytest.approx(mass, abs=1e-9)
    none = ppm.codelengths(spark.createDataFrame([(1, "xy")], "id long, text string"), "id", abab.where("k < 0").unionByName(spark.createDataFrame([("m", 9, "q", "q", 1, 1)], abab.schema)), 0, 256).first()
    assert none.bits == pytest.approx(3 * math.log2(257))


def static(texts, order, alphabet=256):
    """The adaptive model, trained on texts and then frozen."""
    m = fold.AdaptivePPM(order, alphabet)
    for t in texts:
        for s in [*map(ord, t), fold.END]:
            m.learn(s)
    return m


def frozen_bits(m, text):
    cost, m.history = 0.0, []
    for s in [*map(ord, text), fold.END]:
        cost += m.bits(s)
        if s != fold.END:
            m.history = (m.history + [s])[-m.order - 1 :]
    m.history = []
    return cost


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_fold_equals_joins(spark, order):
    rng = np.random.default_rng(order)
    texts = ["".join(rng.choice(list("abcd "), rng.integers(1, 60))) for _ in range(12)]
    tests = ["".join(rng.choice(list("abcde "), rng.integers(0, 40))) for _ in range(8)]
    counts = ppm.train(spark.createDataFrame([("m", t) for t in texts], "model string, text string"), order)
    got = {r.id: r.bits for r in ppm.codelengths(spark.createDataFrame(list(enumerate(tests)), "id long, text string"), "id", counts, order, 256).collect()}
    m = static(texts, order)
    held = rewrite.StaticModels.of(counts, order, 256)
    for i, t in enumerate(tests):
        assert got[i] == pytest.approx(frozen_bits(m, t), abs=1e-6)
        assert got[i] == pytest.approx(sum(held.bits("m", t[:k], s) for k, s in enumerate([*t, S])), abs=1e-6)


def test_rejected_settings(spark, abab, tmp_path):
    with pytest.raises(ValueError):
        ppm.check(2, "A", 256)
    with pytest.raises(ValueError):
        rewrite.parse_rule("1 2 %m -> x")
    assert rewrite.parse_rule("1 4 ox -> o") == ("ox", "o", 2.0)
    path = str(tmp_path / "model")
    models.write_model(abab, path, "static", order=1)
    back = models.read_model(spark, path, title="new")
    assert back.count() == abab.count() and {r.title for r in back.collect()} == {"new"}
    with pytest.raises(ValueError):
        models.thaw(back)
    models.write_model(abab, path, "dynamic")
    a, b = (spark.createDataFrame([("m", t)], "model string, text string") for t in ("abab", "abc"))
    more = models.continue_training(models.read_model(spark, path), a, b, 1)
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, ppm.train(a.unionByName(b), 1).collect()))


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/x.txt").write_text("hello")
    (tmp_path / "m.dat").write_text("en path/en.model\n\nfr\tpath/fr.model\n")
    assert [r.length for r in models.files(spark, str(tmp_path / "d")).collect()] == [5]
    assert [tuple(r) for r in models.manifest(spark, str(tmp_path / "m.dat")).collect()] == [("en", "path/en.model"), ("fr", "path/fr.model")]
    out = str(tmp_path / "report")
    figures, n = models.monitored(len, "abc")
    for _ in range(2):
        models.append_report(spark, [{"dataset": "d", "model": "gzip", "original_size": 100, "compressed_size": 25, "cr": 0.25} | figures], out)
    assert n == 3 and spark.read.parquet(out).agg(F.sum("cr")).first()[0] == 0.5
    models.write_ranks(spark.createDataFrame([(0, 1, 5), (0, 0, 3)], "doc long, pos long, rank int"), str(tmp_path / "ranks"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ranks")).collect()] == ["3", "5"]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.range_bits(F.lit(0), F.lit(4), F.lit(4))) == 0 and one(T.range_bits(F.lit(0), F.lit(1), F.lit(4))) == 2
    assert [one(T.sss_bits(F.lit(i))) for i in (0, 1, 4, 5, 20)] == [1, 4, 4, 7, 7]
    assert [one(T.sss_code(F.lit(i))) for i in (0, 1, 4, 5)] == ["0", "1000", "1011", "1100000"]
    assert [tuple(p) for p in one(T.nonword_words(F.lit("Hi, you!")))] == [("", "Hi"), (", ", "you"), ("!", "")]
    assert one(T.symbols(F.lit("aé"))) == [97, 233, T.SENTINEL_SYMBOL] and one(T.chars(F.lit(""))) == []
    assert one(T.unescape(T.escape(F.lit("a\\b é\n\x01")))) == "a\\b é\n\x01"
    assert one(T.to_ascii(F.lit("é1"))) == "?1"


def test_identification_ties(spark):
    costs = spark.createDataFrame([(1, "b", 5.0, 3), (1, "a", 5.0, 3), (1, "c", 9.0, 3)], "id long, model string, bits double, symbols long")
    r = identify(costs, "id").first()
    assert (r.predicted, r.runner_up) == ("a", "b")


def test_dictionary_order(spark):
    t = spark.createDataFrame([(2, 0, "x"), (1, 1, "y"), (1, 0, "z"), (3, 0, "z")], "d long, p long, w string").repartition(3)
    assert sorted((r.key_id, r.w, r.key_count) for r in words.dictionary(t, ["d", "p"], "w").collect()) == [(0, "z", 2), (1, "y", 1), (2, "x", 1)]


def test_arithmetic_coding():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"abab" * 40, bytes(rng.integers(0, 256, 300, dtype=np.uint8)), "Ünïcode ñ text, text, text".encode()):
        for order in (0, 2, 4):
            code, bits = fold.encode(data, fold.AdaptivePPM(order))
            assert bytes(fold.decode(code, fold.AdaptivePPM(order))) == data
            assert abs(len(code) * 8 - bits) <= 24
    numbers = [5, 0, 70000, 5, 5, 123456]
    code, _ = fold.encode(numbers, fold.AdaptivePPM(1, alphabet=1 << 20))
    assert fold.decode(code, fold.AdaptivePPM(1, alphabet=1 << 20)) == numbers
    assert fold.eol_choice("a b\na b\n", fold.AdaptivePPM(2))[2] in range(3)


def test_ranks():
    r = fold.PPMRanker().ranks(b"abababab")
    assert fold.PPMRanker().restore(r) == b"abababab" and fold.rank_unpack(fold.rank_pack([0, 70000, 3])) == [0, 70000, 3]
    assert sum(x == 0 for x in r) >= 4


def test_segmentation_and_markup(spark):
    train = spark.createDataFrame([("m", "the cat sat on the mat and the cat ran to the hat " * 6)], "model string, text string")
    m = rewrite.StaticModels.of(ppm.train(train, 3), 3)
    out, cost = rewrite.segment("thecatsatonthemat", m, "m")
    assert out.strip() == "the cat sat on the mat" and cost > 0
    text = "catsat"
    every = [text[0]]
    for c in text[1:]:
        every = [x + y for x in every for y in (c, " " + c)]
    every = [x + e for x in every for e in ("", " ")]
    price = lambda t: sum(m.bits("m", t[:i], s) for i, s in enumerate([*t, S]))
    assert rewrite.segment(text, m, "m", beam=10**6)[1] == pytest.approx(min(map(price, every)))
    two = spark.createDataFrame([("x", "abab " * 30), ("y", "cdcd " * 30)], "model string, text string")
    p = rewrite.markup("abab abab cdcd cdcd", rewrite.StaticModels.of(ppm.train(two, 1), 1), ["x", "y"], 6.0)
    assert p[0] == "x" and p[-1] == "y" and sum(a != b for a, b in zip(p, p[1:])) == 1


def test_alignment():
    assert [b[2:] for b in rewrite.align([100, 50, 60], [104, 112])] == [(1, 1), (2, 1)]
    assert rewrite.align([], []) == []


def test_stream_equals_fold(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    # A file source reads files by their time of change: the parts are written one after the other, in the events' order.
    for low, high in ((-1, 300), (300, 700), (700, 1 << 60)):
        e.where(f"event_id > {low} AND event_id <= {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = adaptive.stream(src, "user_id", "event_id", "event_type", 5).writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.user_id: r for r in spark.sql("SELECT user_id, max_by(bits, symbols) AS bits, max(symbols) AS symbols FROM running GROUP BY user_id").collect()}
    for r in adaptive.fold(e, "user_id", "event_id", "event_type", 5).collect():
        assert last[r.user_id].symbols == r.symbols
        if e.count() and last[r.user_id].bits == pytest.approx(r.bits):
            continue
        raise AssertionError((r, last[r.user_id]))


def test_round_trips_of_queries(spark, sf):
    for name in ("codec_report", "ppm_codec", "rank_codec"):
        assert all(r.restored for r in registry.QUERIES[name](spark, sf).collect())


@pytest.fixture(scope="module")
def two(spark):
    train = spark.createDataFrame([("x", "abab abab acab"), ("x", "the cat sat on the mat"), ("y", "cdcd cdcd"), ("y", "cd cd dc")], "model string, text string")
    return rewrite.StaticModels.of(ppm.train(train, 2), 2)


def price(m, model, text):
    cost, h = 0.0, ""
    for c in [*text, S]:
        cost += m.bits(model, h, c)
        h = (h + c)[-m.order :]
    return cost


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("alphanumeric", [False, True])
def test_rules_against_all_ways(two, before, alphanumeric):
    for text in ("", "abacab", "on-mat", None):
        every = [""]
        for c in text or "":
            ways = [c] if alphanumeric and not c.isalnum() else [c, f" {c}" if before else f"{c} "]
            every = [e + w for e in every for w in ways]
        best = min(every, key=lambda e: price(two, "x", e))
        out, bits, runs = rules.rewrite(text, rules.segmentation(before, alphanumeric), two, ["x"])
        assert bits == pytest.approx(price(two, "x", best)) and price(two, "x", out) == pytest.approx(bits)
        assert sum(n for _, n in runs) == len(out)


def test_rules_of_models_tags_and_letters(two):
    text, names = "abab cd", ["x", "y"]
    every = []
    for first in names:
        for second in (None, *names):
            cost = 2.5 if second else 0.0
            for i, c in enumerate([*text, S]):
                cost += two.bits(first if second is None or i < 5 else second, text[max(0, i - 2) : i], c)
            every.append(cost)
    out, bits, runs = rules.rewrite(text, rules.switching(names, 2.5, True), two, names)
    assert (out, bits) == (text, pytest.approx(min(every))) and "".join(m * n for m, n in runs) in ("xxxxxyy", "xxxxxxx", "yyyyyyy", "yyyyyxx")
    ways = [a + "cd" + b + "a" for a in ("ab", ) for b in ("a", "b")]
    assert rules.rewrite("abcd a", rules.tagging("ab"), two, ["x"])[1] == pytest.approx(min(price(two, "x", w) for w in ways))
    assert rules.rewrite("oxo", rules.compile_rule("ox", "o") + rules.compile_rule("o", "%w".replace("%w", "o")), two, ["x"])[0] == "oo"
    one = lambda target, t="a": rules.rewrite(t, rules.compile_rule("a", target), two, ["x"])
    assert one("%_!a")[:2] == ("!a", pytest.approx(price(two, "x", "a")))
    assert one("%.ba")[:2] == ("ba", pytest.approx(price(two, "x", "ba") - two.bits("x", "", "b")))
    assert one("a%$")[:2] == ("a", pytest.approx(price(two, "x", "a") + price(two, "x", "")))
    assert one("%%")[0] == "%" and one("a", "ab") == (None, None, [])
    apart = rules.rewrite("ac", rules.compile_rule("a", "a") + rules.compile_rule("c", "%m{y}c"), two, ["x"], separate=True)
    assert apart[1] == pytest.approx(two.bits("x", "", "a") + two.bits("y", "", "c") + two.bits("y", "c", S))
    for bad in (("%m", "a"), ("%[ab]", "a"), ("%s", "a"), ("", "a"), ("a", "%w"), ("%w", "%r")):
        with pytest.raises(ValueError):
            rules.compile_rule(*bad)
    loaded = rules.load_rules([r"1 4 \32\ -> %[\1\\2\]", "", "1 1 ox -> o"])
    assert [(r.source[0][1], r.target[0][1], r.bits) for r in loaded] == [(" ", "\1", 2.0), (" ", "\2", 2.0), ("o", "o", 0.0)]


def test_static_codes(spark, two):
    m = rewrite.StaticModels(two.order, 0x110000, two.counts, two.occ)
    for text in ("", "the cat", "zz\x00\U0010ffff", "abab" * 200, "\n\u00e9\u20ac"):
        code = m.encode("x", text)
        assert m.decode("x", code) == text and len(code) * 8 <= price(m, "x", text) + 16
    with pytest.raises(ValueError):
        two.encode("x", "\U0010ffff")
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string")
    coded = rewrite.encode_texts(rows, "id", m, "x")
    assert {r.id: r.text for r in rewrite.decode_texts(coded, "id", m, "x").collect()} == {1: "ab", 2: "", 3: ""}
    numbers = spark.createDataFrame([(1, [3, 3, 7, 0]), (2, []), (3, None)], "id long, numbers array<long>")
    assert {r.id: r.numbers for r in fold.decode_numbers(fold.encode_numbers(numbers, "id"), "id").collect()} == {1: [3, 3, 7, 0], 2: [], 3: []}


def test_symbol_files(spark, tmp_path):
    import struct

    (tmp_path / "a.bin").write_bytes(struct.pack("<3I", 1, 70000, 2147483646))
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r.path[-5]: list(r.symbols) for r in models.symbols(spark, str(tmp_path)).collect()}
    assert got == {"a": [1, 70000, 2147483646]}
    assert models.symbols(spark, str(tmp_path / "a.bin"), 2, False).first().symbols[:2] == [256, 0]
    (tmp_path / "c.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole symbols"):
        models.symbols(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name", ["static_codec", "number_codec", "rule_segmentation", "rule_segmentation_before", "rule_playfair", "rule_tagging", "rule_markup_words", "role_id_with_dynamic"])
def test_rule_and_code_queries(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows and all(r.asDict().get("restored", True) for r in rows)
    if name == "rule_segmentation":
        want = {r.item_id: (r.segmented, r.bits) for r in registry.QUERIES["word_segmentation"](spark, sf).collect()}
        assert {r.item_id: (r.rewritten, r.bits) for r in rows} == want


def tokens_of(text):
    got = [(m[1], m[2]) for m in re.finditer("([^A-Za-z0-9]*)([A-Za-z0-9]*)", text) if m[0]]
    n, w = [a for a, _ in got], [b or S for _, b in got]
    n += [] if w and w[-1] == S else [S]
    stop = lambda x: S if ". " in x or ".\n" in x or x == "." else x
    return [("n", p, t) for p, t in zip([S, *map(stop, n)], n)] + [("w", p, t) for p, t in zip([S, *w], w)]


def test_word_models_against_plain_counts(spark, tmp_path):
    from collections import Counter

    texts = {"a": ["The cat sat. The dog ran.", "cat, dog; cat."], "b": ["0 1 2 3", ""]}
    bundle = word_models.train(spark.createDataFrame([(m, t) for m, ts in texts.items() for t in ts], "model string, text string"), order=1)
    asked = ["The cat ran. Then", "", "...", "cat dog!", None, "7 8. 1"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    got = {(r.id, r.model): (r.bits, r.symbols) for r in word_models.codelengths(rows, "id", bundle, order=1).collect()}
    assert len(got) == 2 * len(asked)
    for m, ts in texts.items():
        seen = [x for t in ts for x in tokens_of(t)]
        pairs, singles = Counter(seen), Counter((k, t) for k, _, t in seen)
        spell = {k: static(sorted({t for q, t in singles if q == k and t != S}), 1, 65536) for k in "nw"}
        for i, text in enumerate(asked):
            cost = 0.0
            for k, p, t in tokens_of(text or ""):
                row = {z: n for (q, y, z), n in pairs.items() if (q, y) == (k, p)}
                flat = {z: n for (q, z), n in singles.items() if q == k}
                if t in row:
                    cost -= math.log2(row[t] / (sum(row.values()) + len(row)))
                    continue
                if row:
                    cost -= math.log2(len(row) / (sum(row.values()) + len(row)))
                cost -= math.log2(flat.get(t, len(flat)) / (sum(flat.values()) + len(flat)))
                if t not in flat and t != S:
                    cost += frozen_bits(spell[k], t)
            assert got[i, m] == (pytest.approx(cost), len(tokens_of(text or ""))), (m, text)
    word_models.write(bundle, str(tmp_path / "bundle"))
    again = word_models.codelengths(rows, "id", word_models.read(spark, str(tmp_path / "bundle")), order=1).collect()
    assert {(r.id, r.model): (pytest.approx(r.bits), r.symbols) for r in again} == got


SMALL = ["text_symbols", "nonword_word_pairs", "char_classes", "gram_counts_o2", "cumulative_bounds", "sss_bits", "space_recall_precision", "rank_hit_rates", "lang_id_static", "word_table", "nonword_table", "model_catalogue", "eoln_handling", "model_manifest", "divergence_metrics", "lang_macro_averages", "word_model_pairs"]


@pytest.mark.parametrize("name", SMALL)
def test_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    columns = list(want.columns)
    clean = lambda row: repr(tuple(round(x, 5) if isinstance(x, float) else x for x in row))
    got = sorted(clean(r[k] for k in columns) for r in registry.QUERIES[name](spark, sf).collect())
    assert got == sorted(clean(r) for r in want.fetchall())


@pytest.mark.parametrize("partitions", [4, 64])
def test_dictionary_keeps_all_keys(spark, sf1, partitions):
    """Dense ids over all distinct words of whole documents, whatever the number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        n, distinct, least, most = registry.QUERIES["word_table"](spark, sf1).agg(F.count(F.lit(1)), F.countDistinct("key_id"), F.min("key_id"), F.max("key_id")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    words = {w for r in spark.read.parquet(f"{sf1}/documents.parquet").select("text").collect() for w in re.split(r"[\t-\r ]+", r.text) if w}
    assert (n, distinct, least, most) == (len(words), len(words), 0, len(words) - 1)


def test_sentinel_is_no_symbol(spark):
    """A text may hold any character, private-use ones too."""
    df = spark.createDataFrame([("m", "a\uf8ffb")], "model string, text string")
    assert ppm.train(df, 0).where("k = 0").count() == 4


FOLDS = ["lang_id_static", "lang_id_precision", "lang_confusion", "lang_bits_matrix", "bits_json", "role_id_conversations", "toxic_id_labels", "bigram_pt_bits", "tag_back_off_bits"]


@pytest.mark.parametrize("name", FOLDS)
def test_sql_folds(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = c.sql(registry.ORACLES[f"{name}_folds"])
    columns = list(want.columns)
    clean = lambda row: repr(tuple(round(x, 3) if isinstance(x, float) else x for x in row))
    got = sorted(clean(r[k] for k in columns) for r in registry.QUERIES[f"{name}_folds"](spark, sf).collect())
    assert got == sorted(clean(r) for r in want.fetchall())


def test_folds_score_every_row(spark, sf):
    """Every document and every turn gets a row, held out; the halves swap."""
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in registry.QUERIES["lang_id_static_folds"](spark, sf).collect()} == ids
    turns = spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert registry.QUERIES["role_id_conversations_folds"](spark, sf).count() == turns


@pytest.fixture(scope="module")
def small_sf(spark, sf, tmp_path_factory):
    """A small part of the tables, cut short, for brute force at order 5."""
    out = str(tmp_path_factory.mktemp("o5"))
    cut = lambda t, n: spark.read.parquet(f"{sf}/{t}.parquet").withColumn("text", F.expr(f"left(text, {n})"))
    cut("documents", 120).where("doc_id < 24").write.parquet(f"{out}/documents.parquet")
    cut("conversations", 60).where("conv_id < 8").write.parquet(f"{out}/conversations.parquet")
    cut("benchmark", 80).limit(4).write.parquet(f"{out}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").where("doc_id < 24").write.parquet(f"{out}/labels.parquet")
    return out


def brute_o5(rows, tests):
    """(id, half, model, text) -> {(id, model): bits} with models of the other half; half None: of all rows."""
    out = {}
    for half in {h for _, h, _ in tests}:
        by = {}
        for _, h, m, t in rows:
            if half is None or h != half:
                by.setdefault(m, []).append(t)
        frozen = {m: static(sorted(ts), 5, 65536) for m, ts in by.items()}
        out |= {(i, m): frozen_bits(f, t) for i, h, t in tests if h == half for m, f in frozen.items()}
    return out


def test_order5(spark, small_sf):
    q = lambda n: registry.QUERIES[f"{n}_o5"](spark, small_sf).collect()
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").collect()
    want = brute_o5([(r.doc_id, r.doc_id % 2, r.lang, r.text) for r in docs], [(r.doc_id, r.doc_id % 2, r.text) for r in docs])
    assert {(r.doc_id, r.model): r.bits for r in q("lang_bits_matrix")} == pytest.approx(want, abs=1e-3)
    best = {i: min((round(b, 6), m) for (j, m), b in want.items() if j == i)[1] for i, _ in want}
    found = {r.doc_id: r.predicted for r in q("lang_id_static")}
    assert found == best
    hits = sum(best[r.doc_id] == r.lang for r in docs)
    assert [(r.docs, r.hits) for r in q("lang_id_precision") if r.lang == "all"] == [(len(docs), hits)]
    turns = spark.read.parquet(f"{small_sf}/conversations.parquet").collect()
    rows = [(r.conv_id * 1000 + r.turn, r.conv_id % 2, r.role, r.text) for r in turns]
    want = brute_o5(rows, [(i, h, t) for i, h, _, t in rows])
    got = {r.id: (r.predicted, r.bits) for r in q("role_id_conversations")}
    assert len(got) == len(turns) and all(b == pytest.approx(want[i, m], abs=1e-3) and b <= min(v for (j, _), v in want.items() if j == i) + 1e-3 for i, (m, b) in got.items())
    items = [(r.item_id, None, r.text) for r in spark.read.parquet(f"{small_sf}/benchmark.parquet").collect() if "\n" not in r.text]
    want = brute_o5(rows, items)
    assert items and {(r.item_id, r.model): r.most for r in q("line_bits_max") if (r.item_id, r.model) in want} == pytest.approx(want, abs=1e-3)
    assert len(q("bits_json")) == len(docs) and sum(r.docs for r in q("toxic_id_labels")) == spark.read.parquet(f"{small_sf}/labels.parquet").count()
    assert q("language_markup") and q("lang_confusion")


@pytest.mark.parametrize("order", [0, 1, 2, 5])
def test_prices_of_grams_are_the_same_by_every_way(spark, monkeypatch, order):
    """A table held by workers, rows joined after a count, and the joins of score(); cut texts, alphabets too large for one number."""
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 1500)))
    train = [("a", "abab abc\n\x00é"), ("a", ""), ("b", "ba" * 9), ("b", None), ("b", wide[::-1] + "\U0001f600ab")]
    rows = [(1, "abab"), (2, ""), (3, None), (4, "zz\x00 ab" * 5), (5, wide[:40] + "\U0001f600"), (5, "ab")]
    t = spark.createDataFrame(train, "model string, text string")
    d = spark.createDataFrame(rows, "id long, text string")
    counts = ppm.train(t, order)
    old = ppm.positions(t, ["model"], order).where("s <> '<end>'").groupBy("model", "s").count().collect()
    assert {(r.model, r.s): r["count"] for r in old} == {(r.model, r.s): r.n for r in counts.where("k = 0 AND s <> '<end>'").collect()}
    got = {}
    few = d.where("id <> 5"), ppm.train(t.where("length(text) < 30"), order)
    for way, limits, cut in [("table", {}, 1 << 21), ("cut", {}, 7), ("rows", {"PRICE_BYTES": 0}, 1 << 21), ("joins", {"PRICE_MODELS": 0}, 1 << 21)]:
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(ppm, k, v)
            m.setattr(grams, "SLICE", cut)
            for name, (x, c) in {"wide": (d, counts), "few": few}.items():
                out = ppm.codelengths(x, "id", c, order)
                got[way, name] = {(r.id, r.model): (pytest.approx(r.bits, abs=1e-7), r.symbols) for r in out.collect()}
                if (way, name) == ("table", "few"):  # the grams of the texts are not shuffled to their costs
                    assert "Join" not in out._jdf.queryExecution().toString()
    for (way, name), x in got.items():
        assert x == got["joins", name], way
    a, b = ({tuple(r)[:4]: (r.n, r.cnt) for r in c.collect()} for c in (counts, _trained_in(monkeypatch, t, order, 7)))
    assert a == b


def _trained_in(monkeypatch, t, order, size):
    with monkeypatch.context() as m:
        m.setattr(grams, "SLICE", size)
        return ppm.train(t, order)


@pytest.mark.parametrize("word_starts", [True, False])
def test_markup_without_models_in_the_driver(spark, monkeypatch, word_starts):
    """Many texts at once, from prices of grams, give what markup() gives text by text with the models themselves."""
    rng = np.random.default_rng(5)
    train = spark.createDataFrame([(m, "".join(rng.choice(list(a), 200))) for m, a in (("x", "ab cé"), ("y", "abd\x00 "), ("z", "aabc  "))], "model string, text string")
    texts = ["".join(rng.choice(list("abcdé\x00 q"), n)) for n in (40, 0, 1, 90, 7, 33)] + [None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = ppm.train(train, 2)
    held = rewrite.StaticModels.of(counts, 2)
    names = ["x", "y", "z"]
    paths = [rewrite.markup(t or "", held, names, 3.0, word_starts) for t in texts]
    want = {(i, m, p.count(m), sum(a != z for a, z in zip(p, p[1:]))) for i, p in enumerate(paths) for m in set(p)}
    monkeypatch.setattr(rewrite, "MODEL_ROWS", 1)  # the models are not read into the driver
    for limits, cut in [({}, 1 << 21), ({}, 16), ({"PRICE_BYTES": 0}, 1 << 21), ({"PRICE_MODELS": 0}, 1 << 21)]:
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(ppm, k, v)
            m.setattr(grams, "SLICE", cut)
            got = rewrite.markup_grams(d, "id", counts, 2, names, 3.0, word_starts=word_starts).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("name", ["language_markup", "language_markup_o5"])
def test_markup_queries_hold_no_models(spark, sf, monkeypatch, name):
    monkeypatch.setattr(rewrite, "MODEL_ROWS", 1)
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_cumulative_bounds_of_empty_texts(spark, tmp_path):
    """The SQL splits an empty text into one empty symbol."""
    import duckdb

    rows = [(1, "", "en"), (2, "ab", "en"), (3, "", "en"), (4, "", "fr"), (5, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["cumulative_bounds"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(registry.ORACLES["cumulative_bounds"]).fetchall()) and len(got) == 4


def test_number_roundtrip_meets_once(spark, sf):
    """The codes are encode()'s, keys that go over batches stay whole, and no table is joined to its own codes."""
    rng = np.random.default_rng(3)
    rows = [[int(x) for x in rng.choice([0, 1, 7, 1000, (1 << 20) - 1], n)] for n in (1, 2, 5, 7, 12, 13, 14, 40, 3)]
    d = spark.createDataFrame([(k, p, n) for k, ns in enumerate(rows) for p, n in enumerate(ns)], "k long, p long, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.k: (r.symbols, r.compressed_size, r.restored) for r in fold.number_roundtrip(d.coalesce(1), "k", "p", "n", alphabet=1 << 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: (len(ns), len(fold.encode(ns, fold.AdaptivePPM(1, 1 << 20))[0]), True) for k, ns in enumerate(rows)}
    short = fold.ShortStreams(1, 1 << 20)
    assert all(short.encode(ns) == fold.encode(ns, fold.AdaptivePPM(1, 1 << 20))[0] and short.decode(short.encode(ns)) == ns for ns in [*rows, []])
    assert "Join" not in registry.QUERIES["number_codec"](spark, sf)._jdf.queryExecution().toString()


def test_word_models_side_by_side(spark, monkeypatch):
    """Models priced in one row and in turns give the same; no row is made for each model of a pair."""
    train = spark.createDataFrame([("a", "the cat. The hat 1"), ("b", "a dog, the cat"), (None, "the end"), ("a", None)], "model string, text string")
    d = spark.createDataFrame([(1, "the cat. zebra 77"), (2, ""), (3, None), (4, "a, a, the dog the"), (4, "cat")], "id long, text string")
    bundle = word_models.train(train)
    out = word_models.codelengths(d, "id", bundle)
    got = {(r.id, r.model): (pytest.approx(r.bits), r.symbols) for r in out.collect()}
    assert len(got) == 12 and "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    monkeypatch.setattr(word_models, "ABREAST", 1)
    assert {(r.id, r.model): (r.bits, r.symbols) for r in word_models.codelengths(d, "id", bundle).collect()} == got
    for m in ("a", "b"):  # a model alone prices as beside others
        alone = word_models.codelengths(d, "id", word_models.train(train.where(F.col("model") == m)))
        assert {(r.id, r.model): (r.bits, r.symbols) for r in alone.collect()} == {k: v for k, v in got.items() if k[1] == m}
