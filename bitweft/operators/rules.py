"""Rule sets for minimum-cost rewriting: patterns on the source, templates on the target, dynamic programming over both.

A source is literal characters, `%%`, `%w` (any character) and `%b{name}` (a predicate of the character) or `%f{name}` (a
predicate of model, text and place). A target is literal characters, `%%`, `%w` / `%b` / `%f` (the characters that the
source's wildcards met, in order, the last one again if there are more), `%m{name}` (what follows is predicted by this
model), `%[..]` (one rule for each character named), `%$` (sentinel), `%_` (the next character is put out, not coded) and
`%.` (the next one is put out and enters the context at no cost). `%m`, `%[` and `%r` on the source side are rejected, `%r` on
the target side with them; `%s` too, as a line has no arguments.

States agree in (place, model, contexts); the cheaper stays, the earlier rule at a tie. All paths that stand at one place
are extended together, so none is older than another; `beam` keeps the cheapest of a place (0: all). The null text counts as
empty, the empty one costs its sentinel; a text that no chain of rules covers has no rewriting (null text and bits)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from bitweft.functions.text import SENTINEL
from bitweft.operators.rewrite import StaticModels, parse_rule

ITEM = re.compile(r"%([bfm])\{(\w+)\}|%\[([^\]]+)\]|%(.)|(.)", re.S)

PREDICATES: dict[str, Callable[[str], bool]] = {
    "space": str.isspace, "not_space": lambda c: not c.isspace(), "alnum": str.isalnum, "not_alnum": lambda c: not c.isalnum(),
    "alpha": str.isalpha, "digit": str.isdigit, "upper": str.isupper, "lower": str.islower, "punct": lambda c: c.isascii() and c.isprintable() and not c.isalnum() and c != " ",
}


@dataclass(frozen=True)
class Rule:
    source: tuple[tuple[str, str], ...]
    target: tuple[tuple[str, str], ...]
    bits: float


def _items(pattern: str) -> list[tuple[str, str]]:
    out = []
    for named, name, among, sign, plain in ITEM.findall(pattern):
        out.append((named, name) if named else ("[", among) if among else ("s", "%") if sign == "%" else ("?" if sign == "s" else sign, "") if sign else ("s", plain))
    return out


def compile_rule(source: str, target: str, bits: float = 0.0) -> list[Rule]:
    """The rules of one line: several if the target names alternatives."""
    src = _items(source)
    for kind, name in src:
        if kind not in "swbf" or (kind in "bf" and not name):
            raise ValueError(f"%{kind} on the source side is not supported: {source!r}")
    if not src:
        raise ValueError("a rule takes at least one character")
    ways: list[list[tuple[str, str]]] = [[]]
    wild = any(k != "s" for k, _ in src)
    for kind, name in _items(target):
        if kind == "[":
            ways = [[*w, ("s", c)] for w in ways for c in name]
            continue
        if kind not in "swbfm$_." or (kind == "m" and not name) or (kind in "wbf" and not wild):
            raise ValueError(f"%{kind} on the target side is not supported: {target!r}")
        ways = [[*w, (kind, name)] for w in ways]
    return [Rule(tuple(src), tuple(w), bits) for w in ways]


def load_rules(lines: Iterable[str]) -> list[Rule]:
    r"""Rules of `freq total source -> target` lines; a space at an end of a side is written \32\. Empty lines are passed over."""
    plain = lambda t: re.sub(r"\\(\d+)\\", lambda m: chr(int(m[1])), t)
    parsed = [parse_rule(x) for x in lines if x.strip()]
    return [r for source, target, bits in parsed for r in compile_rule(plain(source), plain(target), bits)]


def segmentation(before: bool = False, alphanumeric: bool = False) -> list[Rule]:
    """Keep each character; or put a space behind (or before) it."""
    c, back = ("%b{alnum}", "%b") if alphanumeric else ("%w", "%w")
    return compile_rule("%w", "%w") + compile_rule(c, f" {back}" if before else f"{back} ")


def playfair() -> list[Rule]:
    """A space before any character, and the x that the cipher put between or behind letters taken out again."""
    return segmentation(before=True) + compile_rule("ox", "o") + compile_rule("xe", "e")


def switching(names: list[str], bits: float, word_starts: bool = False) -> list[Rule]:
    """Keep each character; or predict it, and what follows, by another model: everywhere, or behind spaces."""
    source, front = (" %w", " ") if word_starts else ("%w", "")
    return compile_rule("%w", "%w") + [r for n in names for r in compile_rule(source, f"{front}%m{{{n}}}%w", bits)]


def tagging(tags: str) -> list[Rule]:
    """Every space becomes one of the tags."""
    return compile_rule("%b{not_space}", "%b") + compile_rule(" ", f"%[{tags}]")


def rewrite(text: str | None, rules: list[Rule], models: StaticModels, start: list[str], beam: int = 0, separate: bool = False, predicates: dict[str, Callable] | None = None) -> tuple[str | None, float | None, list[tuple[str, int]]]:
    """The cheapest rewriting, its bits, and its runs (model, characters put out). One path starts in each model of
    `start`. With `separate` each model sees only the characters that it predicted itself, else all see all."""
    text, tests = text or "", {**PREDICATES, **(predicates or {})}
    names = sorted(models.counts)
    keep = models.order
    heads: dict[str, list[Rule]] = {}
    free = []
    for r in rules:
        if r.source[0][0] == "s":
            heads.setdefault(r.source[0][1], []).append(r)
        else:
            free.append(r)
    priced: dict[tuple[str, str, str], float] = {}

    def cost(model: str, history: str, c: str) -> float:
        k = (model, history, c)
        if k not in priced:
            priced[k] = models.bits(*k)
        return priced[k]

    def meets(r: Rule, i: int, model: str) -> list[str] | None:
        if i + len(r.source) > len(text):
            return None
        got = []
        for j, (kind, name) in enumerate(r.source, i):
            c = text[j]
            if kind == "s":
                if c != name:
                    return None
                continue
            if (kind == "b" and not tests[name](c)) or (kind == "f" and not tests[name](model, text, j)):
                return None
            got.append(c)
        return got

    blank = ("",) * (len(names) if separate else 1)
    at: list[dict] = [{} for _ in range(len(text) + 1)]
    for m in start:
        at[0].setdefault((m, blank), (0.0, None))
    for i in range(len(text)):
        states = sorted(at[i].items(), key=lambda x: x[1][0])
        for (model, seen), (bits, path) in states[:beam] if beam else states:
            for r in [*free, *heads.get(text[i], ())]:
                got = meets(r, i, model)
                if got is None:
                    continue
                m, past, b, taken, mode, runs = model, list(seen), bits + r.bits, 0, "", path
                for kind, name in r.target:
                    if kind == "m":
                        m = name
                        continue
                    if kind in "_.":
                        mode = kind
                        continue
                    if kind in "wbf":
                        name, taken = got[min(taken, len(got) - 1)], taken + 1
                    place = names.index(m) if separate else 0
                    if mode != "_":
                        c = SENTINEL if kind == "$" else name
                        if mode != ".":
                            b += cost(m, past[place], c)
                        past[place] = "" if kind == "$" or not keep else (past[place] + c)[-keep:]
                    if kind != "$":
                        runs = (runs, name, m)
                    mode = ""
                key, to = (m, tuple(past)), at[i + len(r.source)]
                if key not in to or b < to[key][0]:
                    to[key] = (b, runs)
        at[i].clear()
    best = None
    for (m, seen), (bits, path) in at[-1].items():
        total = bits + cost(m, seen[names.index(m) if separate else 0], SENTINEL)
        if best is None or total < best[0]:
            best = (total, path)
    if best is None:
        return None, None, []
    out, path = [], best[1]
    while path is not None:
        path, c, m = path
        out.append((c, m))
    out.reverse()
    spans = [(m, sum(1 for _ in run)) for m, run in groupby(m for _, m in out)]
    return "".join(c for c, _ in out), best[0], spans


def rewrite_texts(df: DataFrame, key: str, rules: list[Rule], models: StaticModels, start: list[str], text: str = "text", beam: int = 0, separate: bool = False) -> DataFrame:
    """key, rewritten, bits, runs (model:characters, comma-joined): rewrite() of each row. Models are broadcast, bounded in rows."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [rewrite(t, rules, shared.value, start, beam, separate) for t in b[text]]
            yield pd.DataFrame({key: b[key], "rewritten": [r[0] for r in rows], "bits": pd.Series([r[1] for r in rows], dtype="float64"), "runs": [",".join(f"{m}:{n}" for m, n in r[2]) for r in rows]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, rewritten string, bits double, runs string")
