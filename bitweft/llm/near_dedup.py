"""MinHash near-dedup with sequential Bayesian verification.

1. One pass makes each document's set of distinct word shingles (64-bit hashes), a MinHash signature and the
   keys of its bands. Documents with equal sets form a class; its smallest id stands for it from here on.
2. Within a bucket (a band key that several classes share) a class is paired with the bucket's smallest id, never
   with all others.
3. Signatures of a pair are compared batch by batch. After each batch the posterior probability that the
   similarity reaches the limit, given the agreements so far, decides: below `miss` the pair is dropped.
4. Survivors are verified on the full shingle sets, made again from the whole texts. These steps first meet each
   class with the smallest id that it shares most buckets with.
5. Members of buckets that still hold different components meet by their rarest shingles: a link between two
   components implies a common shingle among the first of both (an exact condition, so no link is lost behind
   the smallest id). Only these pairs go through steps 3 and 4 again. Where more than SHORT members meet, their
   differences from a central text take the place of the shingles (exact as well). Where more than SHORT still
   meet, they are compared in blocks: tests and verification run within the task, and only links leave it.

A pair at similarity 0.8 is missed if it shares no band (4.6e-7) or fails the sequential test (1e-7), at every
size of group. A third of all rows may be in one group: members meet their bucket's smallest id through written
tables whose joins can be split, and the text of a hot id is sent once for every VERIFY_BLOCK partners.

Ids may be of any type that can be ordered (integers, strings, dates).

Edge cases: null or empty text (or only white space) has an empty set and is linked with nothing; fewer words
than a shingle are one shingle; rows without id are never linked (component null, kept); rows with one id are
one node, linked through any of its texts; repeated rows get a row each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bitweft.llm.arrow import as_bytes, map_rows, slices
from bitweft.llm.graph import components
from bitweft.session import Workspace, pick, small, table, without

#: Bands and rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8**6)**48 < 5e-7.
BANDS, ROWS = 48, 6
#: Signature values compared between two decisions.
BATCH = 36
#: Posterior probability under which a pair is dropped before exact verification.
MISS = 1e-7
#: Partners that one copy of a text is compared with.
VERIFY_BLOCK = 128
#: Shingles of one side that a block of verified pairs holds in memory.
VERIFY_SHINGLES = 4_000_000
#: Lists of at most SHORT members give pairs; longer ones are compared in blocks of BLOCK members.
SHORT, BLOCK = 64, 512
#: Ratio between the least sizes of neighbouring size classes.
SIZE_STEP = 1.02
#: A shingle with more than 1/HOT_TOKENS of all occurrences is hot; there are fewer than HOT_TOKENS of these.
HOT_TOKENS = 1 << 16
#: Sides of at most so many rows (some 10 MB), by a count, go to every executor. Every other join carries a hint: Spark
#: judges a side by its files' size, which tells nothing of rows that compress well or are taken apart after reading.
BROADCAST_ROWS = 100_000
#: Shingles that the centres of groups may have together (some 4 MB) to go to every executor.
BROADCAST_SHINGLES = 500_000

_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_K = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_S = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles: A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, k)
    h = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * _M + w[j : n - size + 1 + j]
        return np.unique(_mix(h))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of a set, in pieces that stay in the processor's cache."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    a, b = _A[:, None], _B[:, None]
    for at in range(0, len(x), 512):
        v = x[None, at : at + 512] * a
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v += b
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _K).sum(axis=1, dtype=np.uint64) + _S).view(np.int64)


def least_agreements(limit: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, least agreements): with fewer, P(similarity >= limit) < miss under a uniform prior.

    The posterior of m agreements of n is Beta(m + 1, n - m + 1); its upper tail is a binomial sum. Signature
    values are compared by 8 bits, so unequal ones agree once in 256: the limit is raised accordingly."""
    t = limit + (1 - limit) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, n, digest, sig, keys of docs(id, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, sig, keys = [], [], [], []
            for text in as_bytes(batch, "text"):
                h = shingles(text, k)
                n.append(len(h))
                if len(h):
                    s = signature(h)
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sig.append(s.astype(np.uint8).tobytes())
                    keys.append(band_keys(s))
                else:
                    digest.append(None), sig.append(None), keys.append(None)
            return pa.record_batch({"id": batch.column("id"), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "sig": pa.array(sig, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

        return each

    return map_rows(docs, f"id {docs.schema['id'].dataType.simpleString()}, n long, digest binary, sig binary, keys array<long>", "text", make)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _agreeing(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the signature matrices a, b that pass every step, and their agreements."""
    alive, m, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in steps:
        m[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, done = alive[m[alive] >= least], n
    return alive, m[alive]


def likely(pairs: DataFrame, limit: float, miss: float) -> DataFrame:
    """Sequential verification of (p, id, sp, si): p, id, m of the pairs that stay possible."""
    steps = least_agreements(limit, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alive, m = _agreeing(_matrix(batch.column("sp")), _matrix(batch.column("si")), steps)
            rows = pa.array(alive)
            yield pa.record_batch({"p": batch.column("p").take(rows), "id": batch.column("id").take(rows), "m": pa.array(m, pa.int64())})

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("p", "id", "sp", "si").mapInArrow(run, f"p {kind}, id {kind}, m long")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(p, id) with 100 * intersection >= percent * union on the full sets of docs(id, text)."""
    sent = F.broadcast if 2 * pairs.count() <= BROADCAST_ROWS else lambda df: df.hint("merge")  # members and heads
    blocks = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK).cast("int").alias("blocks"))
    members = pairs.join(sent(blocks), "p").select(F.col("id").alias("who"), "p", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("part"))
    heads = blocks.select(F.col("p").alias("who"), "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("part"))
    wanted = members.unionByName(heads)
    text = docs.join(sent(wanted), F.col("id") == F.col("who")).select("p", "block", "part", "id", "text")
    text = text.repartition("p", "block").sortWithinPartitions("p", "block", "part")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                found = []
                rows = zip(batch.column("p").to_pylist(), batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("id").to_pylist(), as_bytes(batch, "text"))
                for p, block, part, who, t in rows:
                    if key != (p, block):
                        key, sets = (p, block), []
                    h = shingles(t, k)
                    if not len(h):
                        continue
                    if part == 0:
                        sets.append(h)
                        continue
                    for s in sets:
                        both = len(np.intersect1d(s, h, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(h) - both):
                            found.append((p, who))
                            break
                yield pa.record_batch({"u": pa.array([x for x, _ in found], batch.schema.field("id").type), "v": pa.array([x for _, x in found], batch.schema.field("id").type)})

    return text.mapInArrow(run, f"u {kind}, v {kind}")


def linked_in_blocks(rows: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """rows(key, a, b, side, id, comp, sig, text): u, v of links between members of sides 0 and 1 of a block (key, a, b)
    that are in different components.

    The sequential test and the verification run within the task, nothing is put out for pairs that are no links, and
    once two components are linked no more of their pairs are compared. A text goes to a block once. Rows come sorted
    by (key, a, b, side); the sets of side 0 are held in memory, those of side 1 pass by."""
    steps = least_agreements(percent / 100, miss)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, root = None, [], {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for whole in batches:
            for batch in slices(whole, "text"):
                found = []
                columns = [batch.column(c).to_pylist() for c in ("key", "a", "b", "side", "id", "comp", "sig")]
                for *at, side, who, comp, sig, t in zip(*columns, as_bytes(batch, "text")):
                    if key != at:
                        key, held, root = at, [], {}
                        matrix = None
                    h, sig = shingles(t, k), np.frombuffer(sig, np.uint8)
                    if side == 0:
                        held.append((who, comp, h, sig))
                        continue
                    if not held:
                        continue
                    if matrix is None:
                        matrix, sizes = np.stack([x[3] for x in held]), np.array([len(x[2]) for x in held])
                    near = np.flatnonzero(np.minimum(sizes, len(h)) * 100 >= np.maximum(sizes, len(h)) * percent)
                    near = near[_agreeing(np.broadcast_to(sig, (len(near), len(sig))), matrix[near], steps)[0]]
                    for n in near:
                        other, c, s, _ = held[n]
                        if find(c) == find(comp):
                            continue
                        both = len(np.intersect1d(s, h, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(h) - both):
                            found.append((other, who))
                            root[find(c)] = find(comp)
                yield pa.record_batch({"u": pa.array([x for x, _ in found], to_arrow_type(kind)), "v": pa.array([x for _, x in found], to_arrow_type(kind))})

    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")
    return rows.select("key", "a", "b", "side", "id", "comp", "sig", "text").mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """id, comp, n, digest, tokens of docs(id, comp, text): the shingle sets themselves."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, k) for t in as_bytes(batch, "text")]
            digest = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            tokens = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
            return pa.record_batch({"id": batch.column("id"), "comp": batch.column("comp"), "n": pa.array(map(len, sets), pa.int64()), "digest": pa.array(digest, pa.binary()), "tokens": tokens})

        return each

    kind = docs.schema["id"].dataType.simpleString()
    return map_rows(docs.select("id", "comp", "text"), f"id {kind}, comp {kind}, n long, digest binary, tokens array<long>", "text", make)


class NearDuplicates:
    """One run over docs(id, text) with non-null ids of a type that can be ordered."""

    def __init__(self, docs: DataFrame, k: int, percent: int, miss: float):
        self.docs, self.k, self.percent, self.miss = docs, k, percent, miss
        self.ws = Workspace(docs.sparkSession, "near")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(id, n, digest of every document; id, comp of the classes that are linked or share an id)."""
        ws = self.ws
        sketch = ws.put(sketches(self.docs, self.k).withColumn("row", F.monotonically_increasing_id()), "sketches")
        sets = sketch.where("n > 0").select("id", "digest", "row")
        self.classes = ws.put(sets.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first")).select("digest", F.col("first.id").alias("rep"), F.col("first.row").alias("row")), "classes")
        self.reps = ws.put(sketch.join(self.classes.select("digest", "row").hint("merge"), ["digest", "row"]).select("id", "n", "digest", "sig", "keys"), "reps")
        self.members = sketch.select("id", "n", "digest")
        # Rows of one id that fall into several classes join these.
        self.links = None
        twice = sets.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
        if twice.limit(1).count():
            shared = sets.select("id", "digest").join(self.classes.hint("merge"), "digest").join(twice.hint("merge"), "id").select("id", "rep").distinct()
            spread = shared.groupBy("id").agg(F.min("rep").alias("u"))
            self.links = ws.put(shared.join(spread.hint("merge"), "id").where("rep <> u").select("u", F.col("rep").alias("v")), "links")
        self.comps = None

        each = self.reps.select("id", F.explode("keys").alias("key"))
        buckets = ws.put(each.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("last")).where("p <> last").select("key", "p"), "buckets")
        # One row per class with all its shared buckets: whatever is known of a class is joined before these are taken apart.
        held = ws.put(each.join(buckets.hint("merge"), "key").groupBy("id").agg(F.collect_list(F.struct("key", "p")).alias("held")), "held")
        ws.drop(buckets)
        pairs = ws.put(held.select("id", F.explode("held.p").alias("p")).where("p <> id").groupBy("p", "id").agg(F.count(F.lit(1)).alias("shared")), "pairs")
        best = pairs.groupBy("id").agg(F.min_by("p", F.struct(-F.col("shared"), "p")).alias("p")).select("p", "id")
        self.verify(self.tested(best))
        ws.drop(pairs)
        self.cross(held)
        return self.members, self.comps

    def labelled(self, df: DataFrame, column: str, out: str) -> DataFrame:
        c = self.comps.select(F.col("id").alias("__n"), F.col("comp").alias("__c"))
        c = F.broadcast(c) if self.linked <= BROADCAST_ROWS else c.hint("merge")
        return df.join(c, F.col(column) == F.col("__n"), "left").withColumn(out, F.coalesce("__c", F.col(column))).drop("__n", "__c")

    def tested(self, pairs: DataFrame) -> DataFrame:
        """The sequential test of pairs(p, id): p, id, m of those that stay possible."""
        r = self.reps
        both = small(pairs, BROADCAST_ROWS).join(r.select("id", F.col("n").alias("ni"), F.col("sig").alias("si")), "id").join(r.select(F.col("id").alias("p"), F.col("n").alias("np"), F.col("sig").alias("sp")).hint("merge"), "p")
        both = both.where(F.least("ni", "np") * 100 >= F.greatest("ni", "np") * self.percent)
        return self.ws.put(likely(both, self.percent / 100, self.miss).groupBy("p", "id").agg(F.max("m").alias("m")), "alive")

    def verify(self, pairs: DataFrame) -> None:
        """Verify pairs exactly and bring the components up to date with the links found."""
        self.add(verified(self.docs, pairs, self.k, self.percent))

    def add(self, links: DataFrame) -> None:
        found = self.ws.put(links, "links")
        if self.comps is None or found.count():
            self.comps = components(self.ws, found if self.links is None else self.links.unionByName(found))
            self.linked = self.comps.count()
            self.links = self.comps.where("id <> comp").select(F.col("comp").alias("u"), F.col("id").alias("v"))

    def cross(self, held: DataFrame) -> None:
        """Find links between members of a bucket that are still in different components.

        A link needs an overlap that leaves each end at most so many shingles outside; taken in one order for all, the
        rarest first, the first shingles of both ends must then meet (prefix filter). Shingles that only one component
        has come first of all: they can witness no link and only use the allowance up. So a copy that is too far from its group's middle meets no
        one by the common shingles, and lists stay short however large the group. Partners of like size share a class, so that the allowance is tight."""
        ws = self.ws
        named = ws.put(self.labelled(held, "id", "comp").select("id", "comp", F.col("held.key").alias("keys")), "named")
        each = named.select("id", "comp", F.explode("keys").alias("key"))
        mixed = each.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        mixed = ws.put(mixed, "mixed")
        if not mixed.count():
            return
        wanted = ws.put(each.join(small(mixed, BROADCAST_ROWS), "key", "left_semi").select("id", "comp").distinct(), "undecided")
        wanted = small(wanted.select(F.col("id").alias("__id"), "comp"), BROADCAST_ROWS)
        docs = self.docs.join(wanted, F.col("id") == F.col("__id")).select("id", "comp", "text")
        sets = ws.put(set_rows(docs, self.k).where("n > 0").dropDuplicates(["id", "digest"]), "sets")
        share, n = self.percent / 100, F.col("n")
        size = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
        least = lambda c: F.greatest(F.lit(1), F.ceil(F.pow(F.lit(SIZE_STEP), c.cast("double")) * (1 - 1e-9)))
        rows = self.ordered(sets, [], n - F.ceil(n * share - 1e-6) + 1).withColumn("own", size(n)).withColumn("partner", F.explode(F.sequence(size(F.greatest(F.lit(1.0), F.floor(n * share))), size(F.ceil(n / share)))))
        # at least limit * (n + the class's least size) shingles are common to both
        lists = self.first_tokens(rows, [], n - F.ceil(self.limit * (n + least(F.col("partner"))) - 1e-6) + 1)
        self.short_lists(lists.where(F.col("k") <= SHORT), ["token", "low", "high"])
        self.residual(sets, lists.where(F.col("k") > SHORT))

    @property
    def limit(self) -> float:
        """Links have an overlap of at least limit * (sum of both sizes)."""
        return self.percent / (100 + self.percent)

    def ordered(self, sets: DataFrame, by: list[str], most: Column) -> DataFrame:
        """sets(by, id, comp, digest, n, tokens, ...) with, in place of the tokens, `common`: those that several components
        (of a group `by`) have, the rarest first, as (df, token), and `skip`: how many others there are (`all`: of all).
        Rows that skip `most` tokens or more go."""
        tokens = sets.select(*by, "id", "digest", "comp", F.explode("tokens").alias("token"))
        df = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").drop("a", "b")
        df = self.ws.put(df, "df")
        # Shingles with more than 1/HOT_TOKENS of all occurrences number fewer than HOT_TOKENS: their rows pass by a
        # broadcast, and in the join of the rest no key is hot.
        least = int(sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]) // HOT_TOKENS
        key = [*by, "token"]
        hot = tokens.join(F.broadcast(df.where(F.col("df") > least).withColumnRenamed("df", "hot")), key, "left")
        cold = hot.where("hot IS NULL").drop("hot").join(df.where(F.col("df") <= least).hint("merge"), key)
        one = [*by, "id", "digest"]
        common = hot.where("hot IS NOT NULL").withColumnRenamed("hot", "df").select(*one, "token", "df").unionByName(cold.select(*one, "token", "df"))
        common = common.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
        out = sets.withColumn("all", F.size("tokens")).drop("tokens").join(common.hint("merge"), one).withColumn("skip", F.col("all") - F.size("common"))
        return self.ws.put(out.where(most - F.col("skip") > 0), "ordered")

    def first_tokens(self, rows: DataFrame, by: list[str], room: Column) -> DataFrame:
        """by, token, low, high (the size classes of both ends), id, comp, n, digest, own, k: the lists of the first `room`
        tokens of each row of ordered() with `own` and `partner` classes, where several components meet; k is a list's length."""
        rows = rows.withColumn("room", (room - F.col("skip")).cast("int")).where("room > 0")
        rows = rows.select(*by, "id", "comp", "n", "digest", "own", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"), F.explode(F.slice("common", F.lit(1), F.col("room"))).alias("x"))
        lists, key = rows.select(*by, F.col("x.token").alias("token"), "low", "high", "id", "comp", "n", "digest", "own"), [*by, "token", "low", "high"]
        stat = lists.groupBy(*key).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y").drop("x", "y")
        return self.ws.put(lists.join(stat.hint("merge"), key), "lists")

    def residual(self, sets: DataFrame, lists: DataFrame) -> None:
        """Members of longer lists, by their differences from a centre.

        The members that meet in lists with one largest component are a group, a text of that component is its centre c.
        With A shingles that c lacks and R that it lacks of c's, a set has the weight w = limit * A + (1 - limit) * R, and
        two sets are linked just if their differences from c have at least w + w' - (1 - 2 * limit) * |c| in common. Those
        within that bound of c are linked with it; any other pair must have differences in common, and the first of them by the same order as
        before, so that near copies with edits of their own meet no one."""
        ws, key, kind = self.ws, ["token", "low", "high"], sets.schema["id"].dataType.simpleString()
        share = lists.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("c"))
        main = share.groupBy(*key).agg(F.max_by("comp", F.struct("c", "comp")).alias("g"))
        members = ws.put(lists.join(main.hint("merge"), key).groupBy("g", "id", "digest", "comp").agg(F.count(F.lit(1)).alias("c")), "groups")
        if not members.count():
            return
        centre = members.where("comp = g").groupBy("g").agg(F.max_by(F.struct("id", "digest"), F.struct("c", "id", "digest")).alias("x")).select("g", "x.id", "x.digest")
        centre = small(centre, BROADCAST_ROWS).join(sets.select("id", "digest", F.col("tokens").alias("centre")), ["id", "digest"])
        centre = ws.put(centre.select("g", F.col("id").alias("cid"), "centre"), "centres")
        short = centre.agg(F.coalesce(F.sum(F.size("centre")), F.lit(0))).first()[0] <= BROADCAST_SHINGLES
        rows = small(members.drop("c", "comp"), BROADCAST_ROWS).join(sets, ["id", "digest"]).join(small(centre, 1000) if short else centre.hint("merge"), "g")
        percent = self.percent

        def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens, added, removed, size = [], [], [], []
                for x, c in zip(batch.column("tokens"), batch.column("centre")):
                    x, c = (np.asarray(v.values).view(np.uint64) for v in (x, c))
                    a, r = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                    tokens.append(np.concatenate([_mix(a), _mix(~r)]).view(np.int64))
                    added.append(len(a)), removed.append(len(r)), size.append(len(c))
                columns = {k: batch.column(k) for k in ("g", "id", "cid", "digest", "n")}
                yield pa.record_batch(columns | {"added": pa.array(added, pa.int64()), "removed": pa.array(removed, pa.int64()), "size": pa.array(size, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

        rows = rows.select("g", "id", "cid", "digest", "n", "tokens", "centre").mapInArrow(differences, f"g {kind}, id {kind}, cid {kind}, digest binary, n long, added long, removed long, size long, tokens array<long>")
        rows = ws.put(rows, "differences")
        both = F.col("size") - F.col("removed")
        self.add(rows.where("id <> cid").where(both * 100 >= (F.col("n") + F.col("removed")) * percent).select(F.col("cid").alias("u"), F.col("id").alias("v")).distinct())
        limit = self.limit
        rows = self.ordered(ws.put(self.labelled(rows.drop("cid"), "id", "comp"), "again").where(F.size("tokens") > 0), ["g"], F.col("all"))
        w = limit * F.col("added") + (1 - limit) * F.col("removed")
        step, free = F.greatest(F.lit(1.0), F.col("size") / 50), (1 - 2 * limit) * F.col("size")
        place = lambda x: F.floor(x / step).cast("int")
        reach = (1 - limit) * (1 - 2 * limit) * (1 + 100 / percent) * F.col("n") + 1
        rows = rows.withColumn("own", place(w)).withColumn("partner", F.explode(F.sequence(place(F.greatest(F.lit(0.0), w - reach)), place(w + reach))))
        room = F.col("all") - F.greatest(F.lit(1), F.ceil(w + F.col("partner") * step - free - 1e-6)) + 1
        lists = self.first_tokens(rows, ["g"], room)
        self.short_lists(lists.where(F.col("k") <= SHORT), ["g", *key])
        self.long_lists(lists.where(F.col("k") > SHORT), ["g", *key])

    def short_lists(self, lists: DataFrame, key: list[str]) -> None:
        """Every two members of lists of at most SHORT rows, by the sequential test, then exactly."""
        right = lists.select(*key, F.col("id").alias("p"), F.col("comp").alias("cp"), F.col("n").alias("np"), F.col("own").alias("op"))
        fit = (F.col("comp") < F.col("cp")) & (F.col("own") + F.col("op") == F.col("low") + F.col("high")) & (F.least("n", "np") * 100 >= F.greatest("n", "np") * self.percent)
        pairs = self.ws.put(lists.join(right.hint("merge"), key).where(fit).select("p", "id").distinct(), "short")
        if pairs.limit(1).count():
            self.verify(self.tested(pairs))

    def long_lists(self, lists: DataFrame, key: list[str]) -> None:
        """What is left of longer lists: members outside the largest component meet all members in blocks, within tasks."""
        share = lists.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        stat = share.groupBy(*key).agg(F.sum("c").alias("size"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.max("n").alias("longest"))
        each = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(VERIFY_SHINGLES) / F.col("longest"))))
        stat = self.ws.put(stat.select(*key, "main", F.ceil((F.col("size") - F.col("most")) / each).cast("int").alias("na"), F.ceil(F.col("size") / BLOCK).cast("int").alias("nb")), "long")
        if not stat.count():
            return
        some = lists.join(stat.hint("merge"), key).withColumn("key", F.xxhash64(*key))
        place = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        zero = some.where("comp <> main").select("key", place("na").alias("a"), every("nb").alias("b"), F.lit(0).alias("side"), "id", "digest", "comp")
        one = some.select("key", every("na").alias("a"), place("nb").alias("b"), F.lit(1).alias("side"), "id", "digest", "comp")
        sides = zero.unionByName(one).join(self.reps.select("id", "digest", "sig").hint("merge"), ["id", "digest"])
        rows = sides.join(self.docs.select(F.col("id").alias("__id"), "text").hint("merge"), F.col("id") == F.col("__id")).drop("__id")
        self.add(linked_in_blocks(rows, self.k, self.percent, self.miss))


def verdicts(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (smallest id reachable), kept (its own component's id)."""
    d = pick(docs, id=id_col, text=text_col)
    near = NearDuplicates(d.where("id IS NOT NULL"), k, percent, miss)
    members, _ = near.run()
    by_class = near.labelled(near.classes, "rep", "comp").select("digest", "comp")
    out = _lookup(members, near.ws.put(by_class, "by_class"), near.ws)
    lost = d.where("id IS NULL").select("id", F.lit(None).cast("long").alias("n"), "text")
    if lost.limit(1).count():
        nameless = sketches(lost.select("id", "text"), k).select("id", F.col("n").alias("n_shingles"), F.lit(None).cast(out.schema["component_id"].dataType).alias("component_id"), F.lit(True).alias("kept"))
        out = out.unionByName(nameless)
    return out


def _lookup(members: DataFrame, known: DataFrame, ws: Workspace) -> DataFrame:
    """Each row's component through its class. Classes with more than a 4096th of the rows number fewer than
    4096 and are broadcast; no other class makes a key hot."""
    size = members.where("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    least = max(members.count() // 4096, 1000)
    sized = ws.put(known.join(size.hint("merge"), "digest"), "sized")
    full, empty = members.where("n > 0"), members.where("n = 0")
    hot = full.join(F.broadcast(sized.where(F.col("c") > least).select("digest", F.col("comp").alias("hot"))), "digest", "left")
    a = hot.where("hot IS NOT NULL").select("id", "n", F.col("hot").alias("comp"))
    b = hot.where("hot IS NULL").select("id", "n", "digest").join(sized.where(F.col("c") <= least).select("digest", "comp").hint("merge"), "digest", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"))
    c = empty.select("id", "n", F.col("id").alias("comp"))
    return a.unionByName(b).unionByName(c).select("id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of near duplicates, with all their columns."""
    gone = verdicts(docs, k, percent, id_col=id_col, text_col=text_col).where("NOT kept").select("id")
    return without(docs, id_col, Workspace(docs.sparkSession, "near").put(gone, "gone"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(table(spark, sf_dir, "documents"), k=4, percent=80)
    return v.withColumnRenamed("id", "doc_id").select("doc_id", "n_shingles", "component_id", "kept")
