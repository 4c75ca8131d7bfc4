"""Minimum-cost rewriting: Viterbi over (position, model, context), one text at a time.

Rules rewrite one source character: `keep`, `insert` a string after (or before) it, or `switch` to another
model. States that agree in model and context are merged, the cheaper path staying; `beam` limits the states
of a position. Static costs come from a broadcast of the count tables of ppm.train()."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bitweft.functions.text import SENTINEL
from bitweft.operators import grams, ppm
from bitweft.operators.fold import Decoder, Encoder
from bitweft.session import Workspace

#: Rows of the count tables that a worker may hold (some 1 GB in Python).
MODEL_ROWS = 4_000_000


@dataclass
class StaticModels:
    """Count tables held in a worker: model -> context -> symbol -> count."""

    order: int
    alphabet: int
    counts: dict = field(default_factory=dict)
    occ: dict = field(default_factory=dict)

    @classmethod
    def of(cls, counts: DataFrame, order: int, alphabet: int = 65536) -> StaticModels:
        """Reads the tables to broadcast them, after a count: models of more than MODEL_ROWS rows are refused."""
        if counts.limit(MODEL_ROWS + 1).count() > MODEL_ROWS:
            raise ValueError(f"models for rewriting are held in each worker and have at most {MODEL_ROWS} rows; take a lower order")
        out = cls(order, alphabet)
        for r in counts.collect():
            out.counts.setdefault(r.model, {}).setdefault(r.ctx, {})[r.s] = r.cnt
            out.occ.setdefault(r.model, {})[r.ctx] = out.occ.setdefault(r.model, {}).get(r.ctx, 0) + r.n
        return out

    def bits(self, model: str, history: str, s: str) -> float:
        table, occ, cost, gone = self.counts[model], self.occ[model], 0.0, set()
        for k in range(min(self.order, len(history)), -1, -1):
            c = history[len(history) - k :] if k else ""
            f = table.get(c)
            if not f or (k and occ.get(c, 0) < 2):
                continue
            left = sum(n for x, n in f.items() if x not in gone)
            total = left + len(f)
            if s in f:
                return cost - math.log2(f[s] / total)
            if left:
                cost -= math.log2(len(f) / total)
            gone.update(x for x in f if x != SENTINEL)
        return cost + math.log2(self.alphabet - len(gone) + 1)

    def levels(self, model: str, history: str) -> Iterator[tuple[list[tuple[str, int]], int]]:
        """The symbols with counts, in order, and the escape count, of each context from the longest; exclusions applied."""
        table, occ, gone = self.counts[model], self.occ[model], set()
        for k in range(min(self.order, len(history)), -1, -1):
            c = history[len(history) - k :] if k else ""
            f = table.get(c)
            if f and (not k or occ.get(c, 0) >= 2):
                yield sorted((x, n) for x, n in f.items() if x not in gone), len(f)
                gone.update(x for x in f if x != SENTINEL)
        yield [(x, -1) for x in sorted(gone, key=ord)], 0

    def encode(self, model: str, text: str) -> bytes:
        """Arithmetic code of the text and its sentinel; the model does not learn."""
        coder, history = Encoder(), ""
        for s in [*text, SENTINEL]:
            if s != SENTINEL and ord(s) >= self.alphabet:
                raise ValueError(f"symbol {ord(s)} is beyond the alphabet of {self.alphabet}")
            for known, escape in self.levels(model, history):
                if not escape:
                    n = self.alphabet - len(known)
                    at = n if s == SENTINEL else ord(s) - sum(x < s for x, _ in known)
                    coder.put(at, at + 1, n + 1)
                    break
                low = sum(n for x, n in known if x < s)
                left = sum(n for _, n in known)
                hit = next((n for x, n in known if x == s), 0)
                if hit:
                    coder.put(low, low + hit, left + escape)
                    break
                if left:
                    coder.put(left, left + escape, left + escape)
            history = (history + s)[-self.order :] if self.order else ""
        return coder.done()

    def decode(self, model: str, code: bytes) -> str:
        coder, history, out = Decoder(code), "", []
        while True:
            for known, escape in self.levels(model, history):
                if not escape:
                    n = self.alphabet - len(known)
                    at = coder.target(n + 1)
                    coder.take(at, at + 1, n + 1)
                    if at == n:
                        s = SENTINEL
                        break
                    for x, _ in known:  # in order, so each one passed moves the place by one
                        at += ord(x) <= at
                    s = chr(at)
                    break
                left = sum(n for _, n in known)
                if not left:
                    continue
                at, low, s = coder.target(left + escape), 0, None
                for x, n in known:
                    if at < low + n:
                        s = x
                        break
                    low += n
                coder.take(low, low + (n if s is not None else escape), left + escape)
                if s is not None:
                    break
            if s == SENTINEL:
                return "".join(out)
            out.append(s)
            history = (history + s)[-self.order :] if self.order else ""


RULE = re.compile(r"^\s*(\d+)\s+(\d+)\s+(.*?)\s*->\s*(.*?)\s*$")


def parse_rule(line: str) -> tuple[str, str, float]:
    """`freq total source -> target`: source, target and -log2(freq / total)."""
    m = RULE.match(line)
    if not m or not 0 < int(m[1]) <= int(m[2]):
        raise ValueError(f"not a rule: {line!r}")
    for unsupported in ("%m", "%["):
        if unsupported in m[3]:
            raise ValueError(f"{unsupported} on the source side is not supported")
    return m[3], m[4], -math.log2(int(m[1]) / int(m[2]))


def segment(text: str, models: StaticModels, model: str, beam: int = 64, insert: str = " ", before: bool = False, alphanumeric: bool = False) -> tuple[str, float]:
    """Cheapest text that becomes `text` when `insert` is taken out again: at each character keep, or keep and insert."""
    keep = models.order
    states: dict[str, tuple[float, str]] = {"": (0.0, "")}
    for c in text:
        new: dict[str, tuple[float, str]] = {}
        for history, (cost, out) in states.items():
            ways = [c]
            if not alphanumeric or c.isalnum():
                ways.append(insert + c if before else c + insert)
            for way in ways:
                h, b = history, cost
                for x in way:
                    b += models.bits(model, h, x)
                    h = (h + x)[-keep:] if keep else ""
                if h not in new or b < new[h][0]:
                    new[h] = (b, out + way)
        states = dict(sorted(new.items(), key=lambda x: x[1][0])[:beam]) if len(new) > beam else new
    best = min(((b + models.bits(model, h, SENTINEL), out) for h, (b, out) in states.items()), default=(0.0, ""))
    return best[1], best[0]


def markup(text: str, models: StaticModels, names: list[str], switch_bits: float, word_starts: bool = False) -> list[str]:
    """The model of each character on the cheapest path; a switch costs `switch_bits` and clears no context."""
    keep = models.order
    if not text:
        return []
    at = {m: (0.0 if i == 0 else switch_bits, None) for i, m in enumerate(names)}
    back: list[dict[str, str]] = []
    for i, c in enumerate(text):
        h = text[max(0, i - keep) : i]
        cost = {m: at[m][0] + models.bits(m, h, c) for m in names}
        free = not word_starts or c == " "
        best = min(names, key=lambda m: (cost[m], names.index(m)))
        step, new = {}, {}
        for m in names:
            if free and cost[best] + switch_bits < cost[m]:
                new[m], step[m] = (cost[best] + switch_bits, None), best
            else:
                new[m], step[m] = (cost[m], None), m
        at = new
        back.append(step)
    m = min(names, key=lambda x: (at[x][0], names.index(x)))
    out = []
    for step in reversed(back):
        m = step[m]
        out.append(m)
    return out[::-1]


def markups(texts: list[str], costs: np.ndarray, switch_bits: float, word_starts: bool) -> np.ndarray:
    """markup() of many texts at once: the number of each symbol's model, one text behind the other; costs is a row of
    each symbol's cost under each model. The texts step on together, the longest first, so that those that go on stand in front."""
    sizes = np.array([len(t) for t in texts], np.int64)
    models = costs.shape[1]
    starts = np.cumsum(sizes) - sizes
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    free = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) == ord(" ") if word_starts else np.ones(len(costs), bool)
    going = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts longer than each place
    at = np.tile(np.where(np.arange(models) == 0, 0.0, switch_bits), (len(sizes), 1))
    back, own = np.empty((len(costs), models), np.uint8), np.arange(models, dtype=np.uint8)
    for i, n in enumerate(going):
        here = starts[:n] + i
        now = at[:n] + costs[here]
        best = now.argmin(axis=1)
        other = (now[np.arange(n), best] + switch_bits)[:, None]
        change = free[here][:, None] & (other < now)
        at[:n] = np.where(change, other, now)
        back[here] = np.where(change, best[:, None], own)
    m, path = at.argmin(axis=1), np.empty(len(costs), np.uint8)
    for i in range(len(going) - 1, -1, -1):
        here = starts[: going[i]] + i
        m[: going[i]] = path[here] = back[here, m[: going[i]]]
    return path


def shares(keys: list, texts: list[str], path: np.ndarray, names: list[str], key: str, kind: pa.DataType) -> pa.RecordBatch:
    """key, model, symbols, switches of each text's path; the models it uses, in the order of names."""
    sizes = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    symbols = np.bincount(of * len(names) + path, minlength=len(texts) * len(names))
    changes = np.bincount(of[1:][(path[1:] != path[:-1]) & (of[1:] == of[:-1])], minlength=len(texts))
    used = np.flatnonzero(symbols)
    row, m = used // len(names), used % len(names)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind).take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(m)), pa.array(symbols[used], pa.int64()), pa.array(changes[row], pa.int64())], names=[key, "model", "symbols", "switches"])


def markup_grams(df: DataFrame, key: str, counts: DataFrame, order: int, names: list[str], switch_bits: float = 12.0, text: str = "text", word_starts: bool = True, alphabet: int = 65536) -> DataFrame:
    """markup_texts() with the count tables of ppm.train() themselves: a symbol's cost depends on the text before it alone,
    so the distinct grams of the texts are priced once, and neither the driver nor a worker holds the models."""
    kind = df.schema[key].dataType
    schema, arrow = f"{key} {kind.simpleString()}, model string, symbols long, switches long", to_arrow_type(kind)
    wanted = Workspace(df.sparkSession, "grams").put(grams.counted(df, [], order, text, False).select("ctx", "s"), "distinct")
    table = ppm.prices(wanted, names, counts, order, alphabet)
    if isinstance(table, grams.Prices):
        return grams.per_text(df, key, table, text, schema, lambda keys, texts, costs: shares(keys, texts, markups(texts, costs, switch_bits, word_starts), names, key, arrow))
    if table is None:
        table = ppm.wide(wanted, names, counts, order, alphabet)
    rows = df.select(key, F.col(text).alias("__text"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("__row"))
    at = ppm.positions(rows, ["__row", key, "__text"], order, "text", False).withColumn("ctx", F.coalesce(*[ppm.context(k) for k in range(order, -1, -1)]))
    each = F.struct("pos", F.array(*[f"c{i}" for i in range(len(names))]).alias("c"))
    rows = at.join(table, ["ctx", "s"]).groupBy("__row", key, "__text").agg(F.array_sort(F.collect_list(each)).alias("a")).select(key, "__text", F.col("a.c").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, costs = b.column("__text").to_pylist(), b.column("c").flatten().flatten().to_numpy().reshape(-1, len(names))
            yield shares(b.column(key).to_pylist(), texts, markups(texts, costs, switch_bits, word_starts), names, key, arrow)

    return rows.mapInArrow(run, schema)


def segment_texts(df: DataFrame, key: str, models: StaticModels, model: str, text: str = "text", beam: int = 64) -> DataFrame:
    """key, segmented, bits: word segmentation of each text."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [segment(t or "", shared.value, model, beam) for t in b[text]]
            yield pd.DataFrame({key: b[key], "segmented": [r[0] for r in rows], "bits": [r[1] for r in rows]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, segmented string, bits double")


def markup_texts(df: DataFrame, key: str, models: StaticModels, names: list[str], switch_bits: float = 12.0, text: str = "text", word_starts: bool = True) -> DataFrame:
    """key, model, symbols, switches: share of each model on the cheapest path of each text."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                path = markup(t or "", shared.value, names, switch_bits, word_starts)
                switches = sum(a != z for a, z in zip(path, path[1:]))
                out += [(k, m, path.count(m), switches) for m in names if m in path]
            yield pd.DataFrame(out, columns=[key, "model", "symbols", "switches"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, model string, symbols long, switches long")


def encode_texts(df: DataFrame, key: str, models: StaticModels, model: str, text: str = "text") -> DataFrame:
    """key, code: each text's arithmetic code under a static model (null: empty). decode_texts() is its inverse."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "code": [shared.value.encode(model, t or "") for t in b[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, code binary")


def decode_texts(df: DataFrame, key: str, models: StaticModels, model: str, code: str = "code") -> DataFrame:
    """key, text: the texts of encode_texts()'s codes."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [shared.value.decode(model, bytes(c)) for c in b[code]]})

    return df.select(key, code).mapInPandas(run, f"{key} {kind}, text string")


#: Variance and the prior of the six bead types of length-based alignment (fixed values of the published method).
BEADS = {(1, 1): 0.89, (1, 0): 0.00495, (0, 1): 0.00495, (2, 1): 0.0445, (1, 2): 0.0445, (2, 2): 0.011}
VARIANCE = 6.8


def align(left: list[int], right: list[int]) -> list[tuple[int, int, int, int]]:
    """Beads (i, j, di, dj) of the cheapest alignment of two lists of sentence lengths."""

    def cost(a: int, b: int, prior: float) -> float:
        if a == 0 and b == 0:
            return -math.log(prior)
        mean = (a + b) / 2
        delta = (b - a) / math.sqrt(mean * VARIANCE)
        tail = math.erfc(abs(delta) / math.sqrt(2))
        return -math.log(max(tail, 1e-300)) - math.log(prior)

    n, m = len(left), len(right)
    best: dict[tuple[int, int], tuple[float, tuple[int, int]]] = {(0, 0): (0.0, (0, 0))}
    for i in range(n + 1):
        for j in range(m + 1):
            for (di, dj), prior in BEADS.items():
                if i >= di and j >= dj and (i - di, j - dj) in best and (di or dj):
                    c = best[i - di, j - dj][0] + cost(sum(left[i - di : i]), sum(right[j - dj : j]), prior)
                    if (i, j) not in best or c < best[i, j][0]:
                        best[i, j] = (c, (di, dj))
    out, at = [], (n, m)
    while at != (0, 0):
        di, dj = best[at][1]
        at = (at[0] - di, at[1] - dj)
        out.append((*at, di, dj))
    return out[::-1]


def align_texts(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, i, j, di, dj: sentence beads of two parallel texts, split at line feeds."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *bead) for k, x, y in zip(b[key], b[left], b[right]) for bead in align([len(s) for s in (x or "").split("\n")], [len(s) for s in (y or "").split("\n")])]
            yield pd.DataFrame(out, columns=[key, "i", "j", "di", "dj"])

    return df.select(key, left, right).mapInPandas(run, f"{key} {kind}, i long, j long, di long, dj long")
