"""BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent bytes that stands inside no vocabulary token can never be merged, so a cut there is
certain: every pre-token is split at such pairs, the fragments are encoded independently (and remembered),
and their ids are concatenated. Results equal those of the tokenizers library for byte-level BPE files.

Edge cases: null or empty text has no ids and decodes to the empty text; repeated rows and null ids give a
row each; the special token's own string in a text is that token; an empty table gives an empty result;
extra columns are ignored; very long texts are handled whole, in slices of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.llm.arrow import map_rows
from bitweft.session import pick, table

#: White space and pre-token pattern of byte-level BPE (fixed values of the file format).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Remembered pre-tokens and fragments of a worker; when full, it starts anew.
REMEMBERED = 100_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file, for one worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], (spec["pre_tokenizer"] or {}).get("type")
        if model["type"] != "BPE" or kinds != "ByteLevel" or spec["normalizer"] or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        to_byte = byte_characters()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((raw(a), raw(b)), r)
        inside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.joined = frozenset(inside)
        self.split = regex.compile(_PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self.fast = self._rank_encoder()

    def _rank_encoder(self):
        """A compiled fragment encoder, if the file's ids are in the order of its merges (then id = rank)."""
        order = [self.ids[a + b] for a, b in self.rank]
        if order != sorted(order) or len(set(order)) != len(order) or (order and max(self.ids[bytes([b])] for b in range(256)) > order[0]):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        return tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._encode_single_piece

    def merge(self, fragment: bytes) -> list[int]:
        """BPE of one fragment: the pair of lowest rank is merged, leftmost first, until none is left."""
        parts: list[bytes | None] = [fragment[i : i + 1] for i in range(len(fragment))]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, heap = self.rank.get, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank((parts[i], parts[j]))) is not None:
                heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heappop(heap)
            if parts[i] != a or after[i] >= n or parts[after[i]] != b:
                continue  # one of the two has been merged since
            j = after[i]
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ids[p] for p in parts if p is not None]

    def cut(self, word: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _fragment(self, fragment: bytes) -> bytes:
        found = self.fragments.get(fragment)
        if found is None:
            ids = [self.ids[fragment]] if len(fragment) == 1 else self.fast(fragment) if self.fast else self.merge(fragment)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(fragment) <= 64:
                if len(self.fragments) >= REMEMBERED:
                    self.fragments.clear()
                self.fragments[fragment] = found
        return found

    def _word(self, word: str) -> bytes:
        parts = self.cut(word.encode("utf-8"))
        found = b"".join(map(self._fragment, parts)) if len(parts) > 1 else self._fragment(parts[0])
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, piece in enumerate(self.at_special(text) if self.at_special else [text]):
            if i % 2:
                out.append(struct.pack("<I", self.special[piece]))
            elif piece:
                words = self.split(" " + piece if self.prefix and not piece[0].isspace() else piece)
                get, word = self.known.get, self._word
                out += [get(w) or word(w) for w in words]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _map(docs: DataFrame, id_col: str, text_col: str, path: str, schema: str, row) -> DataFrame:
    d = pick(docs, id=id_col, text=text_col)

    def make():
        bpe = ForcedBoundaryBPE(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return row(bpe, batch)

        return each

    return map_rows(d, f"id {d.schema['id'].dataType.simpleString()}, {schema}", "text", make)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int): the whole text of each document, encoded."""

    def row(bpe, batch):
        ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
        return pa.record_batch({"id": batch.column("id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return _map(docs, id_col, text_col, path, "ids array<int>", row)


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text: decodes ids, special tokens included; null ids decode to the empty text."""
    d = pick(encoded, id=id_col, ids=ids_col)

    def make():
        bpe = ForcedBoundaryBPE(path)
        return lambda batch: pa.record_batch({"id": batch.column("id"), "text": pa.array([bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()], pa.string())})

    return map_rows(d, f"id {d.schema['id'].dataType.simpleString()}, text string", "ids", make)


def roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, for bounded output."""

    def row(bpe, batch):
        n, a, b = [], [], []
        for t in batch.column("text").to_pylist():
            ids = bpe.encode(t or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
        return pa.record_batch({"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return _map(docs, id_col, text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def vocabulary() -> str:
    """Where the public vocabulary file lies; it is a parameter and stays outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "documents"), vocabulary()).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
