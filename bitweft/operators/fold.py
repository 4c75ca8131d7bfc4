"""Adaptive PPM models, arithmetic coding and codecs: folds over one stream each, run in Arrow batches.

An adaptive model learns from every symbol it codes, so a stream is a fold; streams are independent rows. The
same model class scores, encodes and decodes, so a cost and a code always agree."""

from __future__ import annotations

import bz2
import gzip
import lzma
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

END = -1  # the sentinel in folds over symbols


class AdaptivePPM:
    """PPM method C or D with full and update exclusions, learning symbol by symbol.

    A gram's first occurrence makes an entry of count 1. The longest gram that has occurred before gets its
    increment when the next symbol arrives. A context is used once it has occurred twice."""

    def __init__(self, order: int = 3, alphabet: int = 256, escape: str = "D"):
        if escape not in ("C", "D"):
            raise ValueError("only methods C and D are supported")
        self.order, self.alphabet, self.inc = order, alphabet, 2 if escape == "D" else 1
        self.followers: dict[tuple, dict[int, int]] = {}
        self.seen: dict[tuple, int] = {}
        self.history: list[int] = []
        self.due: tuple | None = None

    def _levels(self) -> Iterator[dict[int, int]]:
        h = self.history
        for k in range(min(self.order, len(h)), -1, -1):
            c = tuple(h[len(h) - k :]) if k else ()
            if k == 0 or self.seen.get(c, 0) >= 2:
                yield self.followers.get(c, {})

    def ranges(self, symbol: int) -> list[tuple[int, int, int]]:
        """(low, high, total) of each escape and of the symbol."""
        out, gone = [], set()
        for f in self._levels():
            low, hit = 0, None
            for s, n in f.items():
                if s in gone:
                    continue
                if s == symbol:
                    hit = (low, low + n)
                low += n
            total = low + len(f)
            if hit:
                return [*out, (*hit, total)]
            if low:
                out.append((low, total, total))
            gone.update(s for s in f if s != END)
        n = self.alphabet - len(gone)
        place = n if symbol == END else symbol - sum(1 for s in gone if s < symbol)
        return [*out, (place, place + 1, n + 1)]

    def bits(self, symbol: int) -> float:
        return sum(-math.log2((high - low) / total) for low, high, total in self.ranges(symbol))

    def read(self, target) -> int:
        """The symbol that target(total) and target.take(low, high, total) of a decoder point at."""
        gone: set[int] = set()
        for f in self._levels():
            left = [(s, n) for s, n in f.items() if s not in gone]
            total_n = sum(n for _, n in left)
            if total_n:
                total = total_n + len(f)
                at, low = target.target(total), 0
                for s, n in left:
                    if at < low + n:
                        target.take(low, low + n, total)
                        return s
                    low += n
                target.take(low, total, total)
            gone.update(s for s in f if s != END)
        n = self.alphabet - len(gone)
        at = target.target(n + 1)
        target.take(at, at + 1, n + 1)
        if at == n:
            return END
        for s in sorted(gone):
            if s <= at:
                at += 1
        return at

    def learn(self, symbol: int) -> None:
        if self.due is not None:
            self.followers[self.due[:-1]][self.due[-1]] += self.inc
            self.due = None
        h = self.history
        for k in range(min(self.order, len(h)) + 1):
            c = tuple(h[len(h) - k :]) if k else ()
            gram = (*c, symbol)
            n = self.seen[gram] = self.seen.get(gram, 0) + 1
            if n == 1:
                self.followers.setdefault(c, {})[symbol] = 1
            elif symbol != END:
                self.due = gram
        if symbol == END:
            self.history, self.due = [], None
        else:
            h.append(symbol)
            if len(h) > self.order + 1:
                del h[0]


class Encoder:
    """Arithmetic encoder on 32-bit integers. Equal leading bits of the range go out at once, and so are straddling ones counted."""

    def __init__(self):
        self.low, self.high, self.pending = 0, 0xFFFFFFFF, 0
        self.ready, self.bits, self.n = bytearray(), 0, 0  # whole bytes, and the last bits as a number

    def _out(self, value: int, n: int) -> None:
        """The first bit, those that were pending, which are its opposite, and the rest of n bits."""
        if self.pending:
            first, p = value >> (n - 1), self.pending
            self.bits = (self.bits << (1 + p)) | ((1 << p) if first else (1 << p) - 1)
            self.n, self.pending, n = self.n + 1 + p, 0, n - 1
            value &= (1 << n) - 1
        self.bits, self.n = (self.bits << n) | value, self.n + n
        if self.n >= 256:
            rest = self.n & 7
            self.ready += (self.bits >> rest).to_bytes(self.n >> 3, "big")
            self.bits, self.n = self.bits & ((1 << rest) - 1), rest

    def put(self, low: int, high: int, total: int) -> None:
        span = self.high - self.low + 1
        high = self.low + span * high // total - 1
        low = self.low + span * low // total
        n = 32 - (low ^ high).bit_length()
        if n:
            self._out(low >> (32 - n), n)
            low, high = (low << n) & 0xFFFFFFFF, (high << n) & 0xFFFFFFFF | (1 << n) - 1
        p = 31 - ((low & ~high & 0x7FFFFFFF) ^ 0x7FFFFFFF).bit_length()
        if p:
            self.pending += p
            low, high = (low << p) & 0x7FFFFFFF, (high << p) & 0xFFFFFFFF | 0x80000000 | (1 << p) - 1
        self.low, self.high = low, high

    def done(self) -> bytes:
        self.pending += 1
        self._out(1 if self.low >= 0x40000000 else 0, 1)
        rest = -self.n % 8
        return bytes(self.ready) + (self.bits << rest).to_bytes((self.n + rest) >> 3, "big")


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.low, self.high = data, 0, 0, 0xFFFFFFFF
        self.code = self._read(32)

    def _read(self, n: int) -> int:
        """The next n bits, 32 at most; behind the data they are 0."""
        i, self.at = self.at, self.at + n
        return int.from_bytes(self.data[i >> 3 : (i >> 3) + 5].ljust(5, b"\0"), "big") >> (40 - (i & 7) - n) & (1 << n) - 1

    def target(self, total: int) -> int:
        return ((self.code - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def take(self, low: int, high: int, total: int) -> None:
        span = self.high - self.low + 1
        high = self.low + span * high // total - 1
        low = self.low + span * low // total
        n = 32 - (low ^ high).bit_length()
        if n:
            low, high = (low << n) & 0xFFFFFFFF, (high << n) & 0xFFFFFFFF | (1 << n) - 1
            self.code = (self.code << n) & 0xFFFFFFFF | self._read(n)
        p = 31 - ((low & ~high & 0x7FFFFFFF) ^ 0x7FFFFFFF).bit_length()
        if p:
            low, high = (low << p) & 0x7FFFFFFF, (high << p) & 0xFFFFFFFF | 0x80000000 | (1 << p) - 1
            self.code = (self.code << p) - (((1 << p) - 1) << 31) + self._read(p)
        self.low, self.high = low, high


def encode(symbols: Iterable[int], model: AdaptivePPM) -> tuple[bytes, float]:
    """Code of the symbols and a trailing sentinel, and its cost in bits."""
    coder, cost = Encoder(), 0.0
    for s in [*symbols, END]:
        for low, high, total in model.ranges(s):
            coder.put(low, high, total)
            cost -= math.log2((high - low) / total)
        model.learn(s)
    return coder.done(), cost


def decode(data: bytes, model: AdaptivePPM) -> list[int]:
    coder, out = Decoder(data), []
    while (s := model.read(coder)) != END:
        model.learn(s)
        out.append(s)
    return out


def eol_choice(text: str, model: AdaptivePPM) -> tuple[bytes, float, int]:
    """Codes each line feed as carriage return or as space, whichever is cheaper; a flag bit per line feed undoes it.

    Returns the code, its cost with flags, and how many became spaces."""
    coder, cost, spaces = Encoder(), 0.0, 0
    for c in [*text.encode("utf-8"), END]:
        if c == 10:
            s = min((13, 32), key=model.bits)
            spaces += s == 32
            cost += 1
        else:
            s = c
        for low, high, total in model.ranges(s):
            coder.put(low, high, total)
            cost -= math.log2((high - low) / total)
        model.learn(s)
    return coder.done(), cost, spaces


def lzma_pack(raw: bytes) -> bytes:
    """Level 9 with a dictionary no larger than the text needs: the level's own 64 MB would cost some 670 MB for each text."""
    size = min(1 << 26, max(1 << 12, 1 << (len(raw) - 1).bit_length() if raw else 0))
    return lzma.compress(raw, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9, "dict_size": size}])


CODECS = {
    "gzip": (lambda b: gzip.compress(b, 9, mtime=0), gzip.decompress),
    "zlib": (lambda b: zlib.compress(b, 9), zlib.decompress),
    "bz2": (lambda b: bz2.compress(b, 9), bz2.decompress),
    "lzma": (lzma_pack, lzma.decompress),
}


def compress(df: DataFrame, key: str, text: str = "text", codecs: list[str] | None = None) -> DataFrame:
    """key, codec, original_size, compressed_size, restored: classical codecs at level 9 (smaller is better)."""
    names = codecs or list(CODECS)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                raw = (t or "").encode("utf-8")
                for name in names:
                    pack, unpack = CODECS[name]
                    z = pack(raw)
                    out.append((k, name, len(raw), len(z), unpack(z) == raw))
            yield pd.DataFrame(out, columns=[key, "codec", "original_size", "compressed_size", "restored"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, codec string, original_size long, compressed_size long, restored boolean")


def ppm_roundtrip(df: DataFrame, key: str, text: str = "text", order: int = 3) -> DataFrame:
    """key, original_size, compressed_size, bits, restored: adaptive PPM code of each text's bytes, decoded again."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                raw = (t or "").encode("utf-8")
                code, cost = encode(raw, AdaptivePPM(order))
                out.append((k, len(raw), len(code), cost, bytes(decode(code, AdaptivePPM(order))) == raw))
            yield pd.DataFrame(out, columns=[key, "original_size", "compressed_size", "bits", "restored"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, original_size long, compressed_size long, bits double, restored boolean")


class ShortStreams:
    """encode() and decode() of short streams of whole numbers, each with a model of its own. What the model knows depends on
    which numbers are equal only, so its levels are kept by that pattern: each number stands as its place among the distinct ones."""

    LONGEST, KEPT = 12, 50_000

    def __init__(self, order: int, alphabet: int):
        self.order, self.alphabet = order, alphabet
        self.kept: dict[tuple, list[tuple[dict[int, tuple[int, int]], int, int]]] = {}

    def levels(self, seen: tuple[int, ...]) -> list[tuple[dict[int, tuple[int, int]], int, int]]:
        """(range of each symbol, their sum, the total) of each level that codes anything, exclusions applied."""
        if seen not in self.kept:
            if len(self.kept) >= self.KEPT:
                self.kept.clear()
            model, out, gone = AdaptivePPM(self.order, self.alphabet), [], set()
            for x in seen:
                model.learn(x)
            for f in model._levels():
                low, ranges = 0, {}
                for x, n in f.items():
                    if x not in gone:
                        ranges[x] = (low, low + n)
                        low += n
                if low:
                    out.append((ranges, low, low + len(f)))
                gone.update(x for x in f if x != END)
            self.kept[seen] = out
        return self.kept[seen]

    def encode(self, numbers: list[int]) -> bytes:
        if any(not 0 <= n < self.alphabet for n in numbers):
            raise ValueError(f"numbers lie from 0 to {self.alphabet - 1}")
        if len(numbers) > self.LONGEST:
            return encode(numbers, AdaptivePPM(self.order, self.alphabet))[0]
        coder, seen, names = Encoder(), (), {}
        for s in [*numbers, END]:
            x = END if s == END else names.get(s, len(names))
            for ranges, left, total in self.levels(seen):
                if x in ranges:
                    coder.put(*ranges[x], total)
                    break
                coder.put(left, total, total)
            else:
                n = self.alphabet - len(names)
                place = n if x == END else s - sum(y < s for y in names)
                coder.put(place, place + 1, n + 1)
            names.setdefault(s, x)
            seen = (*seen, x)
        return coder.done()

    def decode(self, code: bytes) -> list[int]:
        coder, seen, names, out = Decoder(code), (), [], []
        while True:
            if len(seen) > self.LONGEST:
                return decode(code, AdaptivePPM(self.order, self.alphabet))
            for ranges, left, total in self.levels(seen):
                at = coder.target(total)
                if at < left:
                    x, (low, high) = next((x, r) for x, r in ranges.items() if at < r[1])
                    coder.take(low, high, total)
                    break
                coder.take(left, total, total)
            else:
                n = self.alphabet - len(names)
                at = coder.target(n + 1)
                coder.take(at, at + 1, n + 1)
                if at == n:
                    return out
                for y in sorted(names):
                    at += y <= at
                x = len(names)
                names.append(at)
            out.append(names[x])
            seen = (*seen, x)


def encode_numbers(df: DataFrame, key: str, numbers: str = "numbers", order: int = 1, alphabet: int = 65536) -> DataFrame:
    """key, code: the adaptive code of each row's array of whole numbers from 0 to below `alphabet` (null: empty)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streams = ShortStreams(order, alphabet)
        for b in batches:
            yield pd.DataFrame({key: b[key], "code": [streams.encode([] if a is None else [int(n) for n in a]) for a in b[numbers]]})

    return df.select(key, numbers).mapInPandas(run, f"{key} {kind}, code binary")


def decode_numbers(df: DataFrame, key: str, code: str = "code", order: int = 1, alphabet: int = 65536) -> DataFrame:
    """key, numbers: the arrays of encode_numbers()'s codes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streams = ShortStreams(order, alphabet)
        for b in batches:
            yield pd.DataFrame({key: b[key], "numbers": [streams.decode(bytes(c)) for c in b[code]]})

    return df.select(key, code).mapInPandas(run, f"{key} {kind}, numbers array<bigint>")


def number_roundtrip(df: DataFrame, key: str, place: str, number: str, order: int = 1, alphabet: int = 65536) -> DataFrame:
    """key, symbols, compressed_size, restored: the adaptive code of the numbers of each key in the order of `place`, decoded
    again. Rows meet once, by key; each key's numbers are coded where they lie, one key at a time."""
    kind, schema = to_arrow_type(df.schema[key].dataType), StructType([df.schema[key]]).add("symbols", "long").add("compressed_size", "long").add("restored", "boolean")
    rows = df.select(F.col(key).alias("__k"), F.col(place).alias("__p"), F.col(number).cast("long").alias("__n")).repartition("__k").sortWithinPartitions("__k", "__p", "__n").select("__k", "__n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, open_ = ShortStreams(order, alphabet), []

        def done(groups: list[tuple[object, list[int]]]) -> pa.RecordBatch:
            codes = [streams.encode(ns) for _, ns in groups]
            same = [streams.decode(c) == ns for c, (_, ns) in zip(codes, groups)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in groups], kind), pa.array([len(ns) for _, ns in groups], pa.int64()), pa.array(map(len, codes), pa.int64()), pa.array(same, pa.bool_())], names=schema.names)

        for b in batches:
            groups = [(k, [n for _, n in g]) for k, g in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), key=itemgetter(0))]
            if open_ and groups and open_[0][0] == groups[0][0]:  # the last key of the batch before goes on
                open_[0][1].extend(groups.pop(0)[1])
            groups = open_ + groups
            open_ = groups[-1:]
            if len(groups) > 1:
                yield done(groups[:-1])
        if open_:
            yield done(open_)

    return rows.mapInArrow(run, schema)


def adaptive_bits(df: DataFrame, key: str, text: str = "text", order: int = 3, alphabet: int = 65536) -> DataFrame:
    """key, bits: cost of each text's code points and sentinel under a model that starts empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            costs = []
            for t in b[text]:
                m, cost = AdaptivePPM(order, alphabet), 0.0
                for s in [*map(ord, t or ""), END]:
                    cost += m.bits(s)
                    m.learn(s)
                costs.append(cost)
            yield pd.DataFrame({key: b[key], "bits": costs})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, bits double")


def adaptive_symbol_bits(df: DataFrame, key: str, text: str = "text", order: int = 3, alphabet: int = 65536) -> DataFrame:
    """key, pos, bits: the cost of each code point of a text under a model that starts empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b[key], b[text]):
                m, costs = AdaptivePPM(order, alphabet), []
                for s in map(ord, t or ""):
                    costs.append(m.bits(s))
                    m.learn(s)
                yield pd.DataFrame({key: pd.Series([k] * len(costs), dtype=b[key].dtype), "pos": pd.Series(range(len(costs)), dtype="int64"), "bits": pd.Series(costs, dtype="float64")})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, pos long, bits double")


def rank_pack(ranks: list[int]) -> bytes:
    """Ranks as 32-bit integers, bz2-compressed; rank_unpack is its inverse."""
    return bz2.compress(struct.pack(f"<{len(ranks)}i", *ranks))


def rank_unpack(data: bytes) -> list[int]:
    raw = bz2.decompress(data)
    return list(struct.unpack(f"<{len(raw) // 4}i", raw))


class PPMRanker:
    """Ranks symbols by an adaptive PPM model: the stand-in for a language model's sorted logits (ties by symbol)."""

    def __init__(self, order: int = 2):
        self.model = AdaptivePPM(order)

    def sorted(self) -> list[int]:
        out, gone = [], set()
        for f in self.model._levels():
            new = sorted(((s, n) for s, n in f.items() if s not in gone and s != END), key=lambda x: (-x[1], x[0]))
            out += [s for s, _ in new]
            gone.update(s for s, _ in new)
        return out + [s for s in range(256) if s not in gone]

    def ranks(self, data: bytes) -> list[int]:
        out = []
        for s in data:
            out.append(self.sorted().index(s))
            self.model.learn(s)
        return out

    def restore(self, ranks: list[int]) -> bytes:
        out = bytearray()
        for r in ranks:
            out.append(s := self.sorted()[r])
            self.model.learn(s)
        return bytes(out)


def rank_codec(df: DataFrame, key: str, text: str = "text", ranker=PPMRanker, block: int = 512) -> DataFrame:
    """key, tokens, compressed_size, top1, top16, restored: each block of `block` tokens is ranked on its own."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                raw = (t or "").encode("utf-8")
                ranks = [r for i in range(0, len(raw), block) for r in ranker().ranks(raw[i : i + block])]
                z = rank_pack(ranks)
                back = rank_unpack(z)
                same = b"".join(ranker().restore(back[i : i + block]) for i in range(0, len(back), block)) == raw
                out.append((k, len(raw), len(z), sum(r == 0 for r in ranks), sum(r <= 15 for r in ranks), same))
            yield pd.DataFrame(out, columns=[key, "tokens", "compressed_size", "top1", "top16", "restored"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, tokens long, compressed_size long, top1 long, top16 long, restored boolean")
