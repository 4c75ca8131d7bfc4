"""An adaptive symbol model per stream key: Structured Streaming state that equals the batch fold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def step(counts: dict[str, int], symbols: list[str], alphabet: int) -> float:
    """Order-0 adaptive cost: counts of seen symbols, one escape unit per type, then the unseen share alike."""
    bits = 0.0
    for s in symbols:
        total, types = sum(counts.values()), len(counts)
        if s in counts:
            bits -= math.log2(counts[s] / (total + types))
        else:
            if types:
                bits -= math.log2(types / (total + types))
            bits += math.log2(max(alphabet - types, 1))
        counts[s] = counts.get(s, 0) + 1
    return bits


def fold(df: DataFrame, key: str, order: str, symbol: str, alphabet: int) -> DataFrame:
    """key, symbols, bits in batch: one fold per stream, in the order of (order, symbol)."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, symbol])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "symbols": [len(pdf)], "bits": [step({}, pdf[symbol].tolist(), alphabet)]})

    return df.select(key, order, symbol).groupBy(key).applyInPandas(run, f"{key} {kind}, symbols long, bits double")


def stream(df: DataFrame, key: str, order: str, symbol: str, alphabet: int, timeout: str = "NoTimeout") -> DataFrame:
    """The same over a streaming frame: state is the symbol counts of a key (bounded by the alphabet), the number of
    symbols and the cost so far; each update emits the running cost of the keys that got symbols."""
    kind = df.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, n, bits = state.get if state.exists else ([], [], 0, 0.0)
        counts = dict(zip(names, values))
        rows = pd.concat(list(batches)).sort_values([order, symbol])
        bits += step(counts, rows[symbol].tolist(), alphabet)
        n += len(rows)
        state.update((list(counts), list(counts.values()), n, bits))
        yield pd.DataFrame({key: [k[0]], "symbols": [n], "bits": [bits]})

    return df.select(key, order, symbol).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, symbols long, bits double", "names array<string>, counts array<long>, n long, bits double", "update", timeout)
