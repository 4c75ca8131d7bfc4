"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - s(document)), with thresholds theta_0 <= theta_1 <= ... and one score s
shared by all grades: the sum of the weights of the hashed features that the document has. Features of each
word of the whole text: the word, its beginnings of three to seven characters and the signs it carries.
Weights are fitted with an L1 penalty (proximal, per-coordinate rates), so most are zero and long texts are
not judged by noise. Expected grade and tail probability P(grade >= k) select documents.

The fit reads a bounded sample of the rated documents, at most `per_grade` of each grade and `top_grade` of the
highest, chosen by the hash of their id. Grades are counted over all ratings and each sampled row weighs as its
grade's ratings do, so the thresholds' prior is that of all ratings at every size. Scoring covers every document
and its whole text.

Edge cases: null or empty text has no features, so it gets the prior of the thresholds; ratings that are null
or of unknown ids are ignored, without any rating all documents get the top grade's probability 1; documents
rated twice count twice; repeated rows and null ids give a row each; empty tables and extra columns work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.llm.arrow import map_rows, release, slices
from bitweft.session import pick, table

BITS = 20
#: Rated documents that the fit reads of each grade, and of the top grade.
PER_GRADE, TOP_GRADE = 2500, 6000
REMEMBERED = 400_000

_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features_of(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    core = word.strip(_SIGNS)
    h = xxhash.xxh3_64_intdigest
    mask = (1 << BITS) - 1
    out = [h("w" + core) & mask] if core else []
    out += [h("p" + core[:k]) & mask for k in range(3, 8) if len(core) > k]
    if len(core) < len(word):
        out.append(h("s" + "".join(c for c in word if c in _SIGNS)) & mask)
    return out


def shape_of(text: str, words: list[str], distinct: int) -> list[int]:
    """Hashed features of a text as a whole, from exact counts over all its words."""
    n = len(words)
    length = n.bit_length()
    capitals = sum(map(str.isupper, text.split()))
    tenth = lambda x: min(9, 10 * x // n)
    h, mask = xxhash.xxh3_64_intdigest, (1 << BITS) - 1
    out = [f"d{length}:{min(9, 20 * distinct // n)}", f"c{tenth(capitals)}", f"n{min(length, 5)}"]
    out += [f"d<{k}" for k in range(1, 10) if length >= 6 and distinct * 40 < k * n]
    return [h(x) & mask for x in out]


def features(text: str | None, known: dict[str, tuple[int, ...]], active: np.ndarray | None = None) -> set[int]:
    """The features of a text (only the active ones, if given). `known` remembers words."""
    found: set[int] = set()
    text = text or ""
    words = text.lower().split()
    if not words:
        return found
    distinct = set(words)
    shape = shape_of(text, words, len(distinct))
    found.update(shape if active is None else [i for i in shape if active[i]])
    for word in distinct:
        f = known.get(word)
        if f is None:
            f = tuple(features_of(word))
            if active is not None:
                f = tuple(i for i in f if active[i])
            if len(known) >= REMEMBERED:
                known.clear()
            if len(word) <= 64:
                known[word] = f
        if f:
            found.update(f)
    return found


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -40.0), 40.0)))


class OrdinalModel:
    """Thresholds and the non-zero weights of a cumulative-link model."""

    def __init__(self, theta: list[float], index: np.ndarray, weight: np.ndarray):
        self.theta, self.index, self.weight = theta, index, weight

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, int]], grades: int, epochs: int = 6, rate: float = 0.15, l1: float = 5.0, l2: float = 1.0, weight: list[float] | None = None) -> OrdinalModel:
        """rows: (feature ids, grade). The order of rows is made fixed by a seeded shuffle. weight: of a row, by its grade."""
        size = 1 << BITS
        if not rows:
            return cls([-40.0] * (grades - 1), np.empty(0, np.int64), np.empty(0))
        each = np.ones(grades) if weight is None else np.asarray(weight, float)
        counts = np.bincount([g for _, g in rows], minlength=grades) * each + 0.5
        share = np.cumsum(counts)[:-1] / counts.sum()
        theta = np.log(share / (1 - share))
        z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
        step = np.zeros(grades - 1)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                ids, g = rows[k]
                s = w[ids].sum()
                upper = _sigmoid(theta[g] - s) if g < grades - 1 else 1.0
                lower = _sigmoid(theta[g - 1] - s) if g > 0 else 0.0
                p = max(upper - lower, 1e-9)
                du, dl = upper * (1 - upper), lower * (1 - lower)
                grad = each[g] * (du - dl) / p  # d(-log p)/ds
                g2 = grad * grad
                sigma = (np.sqrt(n[ids] + g2) - np.sqrt(n[ids])) / rate
                z[ids] += grad - sigma * w[ids]
                n[ids] += g2
                zi = z[ids]
                w[ids] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(n[ids])) / rate + l2))
                for at, d in ((g, -each[g] * du / p), (g - 1, each[g] * dl / p)):
                    if 0 <= at < grades - 1:
                        step[at] += d * d
                        theta[at] -= rate * d / (1.0 + np.sqrt(step[at]))
                theta = np.maximum.accumulate(theta)
        index = np.flatnonzero(w)
        return cls(theta.tolist(), index, w[index])

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1..grades-1."""
        return [1.0 - _sigmoid(t - score) for t in self.theta]


def sample(docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int, top_grade: int, id_col: str, text_col: str) -> list[tuple[np.ndarray, int]]:
    """Features and grade of at most per_grade rated documents of each grade, made on the executors."""
    d, r = pick(docs, id=id_col, text=text_col), ratings.where("grade IS NOT NULL AND id IS NOT NULL")
    chosen = None
    for g in range(grades):
        part = r.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(top_grade if g == grades - 1 else per_grade)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = d.join(F.broadcast(chosen.select(F.col("id").alias("__id"), "grade")), F.col("id") == F.col("__id")).select("id", "grade", "text")

    def make():
        known: dict[str, tuple[int, ...]] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.fromiter(features(t, known), np.int32) for t in batch.column("text").to_pylist()]
            return pa.record_batch({"id": batch.column("id").cast(pa.int64()), "grade": batch.column("grade").cast(pa.int32()), "f": pa.array([np.sort(x) for x in ids], pa.list_(pa.int32()))})

        return each

    got = map_rows(rows, "id long, grade int, f array<int>", "text", make).toArrow()
    f = got.column("f").combine_chunks()
    f = f if isinstance(f, pa.Array) else pa.concat_arrays(f.chunks)
    values, offsets = f.values.to_numpy(), f.offsets.to_numpy()
    order = sorted(range(got.num_rows), key=list(zip(got.column("id").to_pylist(), got.column("grade").to_pylist(), range(got.num_rows))).__getitem__)
    grade = got.column("grade").to_pylist()
    return [(values[offsets[i] : offsets[i + 1]].astype(np.int64), grade[i]) for i in order]


def weights(ratings: DataFrame, grades: int, per_grade: int, top_grade: int) -> list[float]:
    """Ratings that a sampled row of each grade stands for, scaled so that a sampled row weighs 1 on average."""
    n = {r["grade"]: r["count"] for r in ratings.where("grade IS NOT NULL AND id IS NOT NULL").groupBy("grade").count().collect()}
    full = [n.get(g, 0) for g in range(grades)]
    taken = [min(x, top_grade if g == grades - 1 else per_grade) for g, x in enumerate(full)]
    return [x * sum(taken) / (t * sum(full)) if t else 1.0 for x, t in zip(full, taken)]


def fit(docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int = PER_GRADE, top_grade: int = TOP_GRADE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on ratings(id, grade in 0..grades-1)."""
    rows = sample(docs, ratings, grades, per_grade, top_grade, id_col, text_col)
    return OrdinalModel.fit(rows, grades, weight=weights(ratings, grades, per_grade, top_grade))


def _scorer(model: OrdinalModel):
    weight = model.dense()
    active = weight != 0
    known: dict[str, tuple[int, ...]] = {}
    return lambda text: float(sum(weight[i] for i in sorted(features(text, known, active))))


def score(docs: DataFrame, model: OrdinalModel, least_grade: int, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, expected_grade, tail_probability = P(grade >= least_grade), kept."""
    d = pick(docs, id=id_col, text=text_col)

    def make():
        of = _scorer(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            tails = [model.tails(of(t)) for t in batch.column("text").to_pylist()]
            tail = [t[least_grade - 1] for t in tails]
            return pa.record_batch({"id": batch.column("id"), "expected_grade": pa.array([float(sum(t)) for t in tails], pa.float64()), "tail_probability": pa.array([float(x) for x in tail], pa.float64()), "kept": pa.array([bool(x >= least_tail) for x in tail], pa.bool_())})

        return each

    return map_rows(d, f"id {d.schema['id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean", "text", make)


def select(docs: DataFrame, model: OrdinalModel, least_grade: int, least_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs with P(grade >= least_grade) >= least_tail, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = batch = part = None
        for batch in batches:
            of = of or _scorer(model)
            for part in slices(batch, text):
                keep = [model.tails(of(t))[least_grade - 1] >= least_tail for t in part.column(text).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))
        del of, batch, part
        release()

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 poor, 2 good."""
    l = table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return l.select(F.col("doc_id").alias("id"), grade.alias("grade"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ratings(spark, sf_dir), 3)
    return score(docs, model, 2).withColumnRenamed("id", "doc_id")
