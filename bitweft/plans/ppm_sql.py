"""SQL statements of the PPM plans, for checks with another engine. Training follows the occurrence-by-occurrence
definition (row numbers), not the closed form that the Spark plan uses."""

from __future__ import annotations

S = "'<end>'"


def symbols(name: str, source: str, keys: str, order: int, sentinel: bool = True) -> str:
    """CTE name(keys, pos, s, p1..): source is a query giving keys and text."""
    lags = ", ".join(f"CASE WHEN pos >= {k} THEN cs[pos - {k} + 1] END AS p{k}" for k in range(1, order + 1))
    end = f"list_append(string_split(text, ''), {S})" if sentinel else "string_split(text, '')"
    end = f"CASE WHEN length(text) = 0 THEN {'[' + S + ']' if sentinel else '[]'} ELSE {end} END"
    return f"""{name}_t AS (SELECT {keys}, {end} AS cs FROM ({source})),
{name}_u AS (SELECT {keys}, cs, unnest(range(0, len(cs))) AS pos FROM {name}_t),
{name} AS (SELECT {keys}, pos, cs[pos + 1] AS s{', ' + lags if lags else ''} FROM {name}_u)"""


def ctx(k: int) -> str:
    return "''" if k == 0 else " || ".join(f"p{j}" for j in range(k, 0, -1))


def longest(order: int) -> str:
    return "coalesce(" + ", ".join([*(ctx(k) for k in range(order, 0, -1)), "''"]) + ")"


def train(source: str, order: int, inc: int = 2, by_rows: bool = False) -> str:
    """CTEs counts(model, k, ctx, s, n, cnt) and st(model, k, ctx, occ, types, total, plain, shadow).

    source gives model, doc, text. by_rows states the definition with row numbers over (doc, pos); the default
    states the sums that follow from it, which is quicker on whole tables."""
    grams = " UNION ALL ".join(f"SELECT model, doc, pos, {k} AS k, {ctx(k)} AS ctx, s, CASE WHEN p{k + 1} IS NULL THEN 1 ELSE 0 END AS b FROM tr" + (f" WHERE p{k} IS NOT NULL" if k else "") for k in range(order + 1))
    out = symbols("tr", source, "model, doc", order + 1) + f",\ngrams AS ({grams}),\n"
    if by_rows:
        out += f"""rn AS (SELECT *, row_number() OVER (PARTITION BY model, k, ctx, s ORDER BY doc, pos) AS r FROM grams),
live AS (SELECT model, doc, pos, max(k) AS top FROM rn WHERE r >= 2 GROUP BY ALL),
counts AS (SELECT rn.model, rn.k, rn.ctx, rn.s, count(*) AS n, 1 + {inc} * count(*) FILTER (WHERE r >= 2 AND rn.k = live.top AND rn.s <> {S}) AS cnt
  FROM rn LEFT JOIN live ON live.model = rn.model AND live.doc = rn.doc AND live.pos = rn.pos GROUP BY ALL),"""
    else:
        out += f"""g AS (SELECT model, k, ctx, s, count(*) AS n, sum(b) AS b FROM grams GROUP BY ALL),
lf AS (SELECT model, k - 1 AS k, substr(ctx, 2) AS ctx, s, count(*) AS l FROM g WHERE k > 0 GROUP BY ALL),
counts AS (SELECT g.model, g.k, g.ctx, g.s, n, CASE WHEN g.s = {S} THEN 1 WHEN g.k >= {order} THEN 1 + {inc} * (n - 1) ELSE 1 + {inc} * (coalesce(l, 0) + b - 1) END AS cnt
  FROM g LEFT JOIN lf ON lf.model = g.model AND lf.k = g.k AND lf.ctx = g.ctx AND lf.s = g.s),"""
    return out + f"""
sh AS (SELECT c.model, c.k, c.ctx, sum(u.cnt) AS shadow FROM counts c JOIN counts u ON u.model = c.model AND u.k = c.k - 1 AND u.ctx = substr(c.ctx, 2) AND u.s = c.s WHERE c.s <> {S} GROUP BY ALL),
st AS (SELECT c.model, c.k, c.ctx, sum(n) AS occ, count(*) AS types, sum(cnt) AS total, count(*) FILTER (WHERE s <> {S}) AS plain, coalesce(any_value(shadow), 0) AS shadow
  FROM counts c LEFT JOIN sh ON sh.model = c.model AND sh.k = c.k AND sh.ctx = c.ctx GROUP BY c.model, c.k, c.ctx)"""


def levels(targets: str, order: int) -> str:
    """CTE lv(model, ctx, s, types0.., total0.., shadow0.., plain0.., cnt0..)."""
    cols, joins = [], []
    for k in range(order, -1, -1):
        at = f"CASE WHEN length(t.ctx) >= {k} THEN right(t.ctx, {k}) END" if k else "''"
        cols.append(f"s{k}.types AS types{k}, s{k}.total AS total{k}, s{k}.shadow AS shadow{k}, s{k}.plain AS plain{k}, c{k}.cnt AS cnt{k}")
        joins.append(f"LEFT JOIN st s{k} ON s{k}.model = t.model AND s{k}.k = {k} AND s{k}.ctx = {at}" + (f" AND s{k}.occ >= 2" if k else ""))
        joins.append(f"LEFT JOIN counts c{k} ON c{k}.model = t.model AND c{k}.k = {k} AND c{k}.ctx = {at} AND c{k}.s = t.s")
    return f"lv AS (SELECT t.model, t.ctx, t.s, {', '.join(cols)} FROM ({targets}) t {' '.join(joins)})"


def bits(order: int, alphabet: int = 65536) -> str:
    parts, found, above = [], "FALSE", "0"
    for k in range(order, -1, -1):
        left = f"(total{k} - {above})"
        parts.append(f"CASE WHEN {found} OR types{k} IS NULL THEN 0 WHEN cnt{k} IS NOT NULL THEN -log2(cnt{k} / ({left} + types{k})) WHEN {left} > 0 THEN -log2(types{k} / ({left} + types{k})) ELSE 0 END")
        found = f"({found} OR (types{k} IS NOT NULL AND cnt{k} IS NOT NULL))"
        above = f"(CASE WHEN types{k} IS NOT NULL THEN shadow{k} ELSE {above} END)"
    return f"({' + '.join(parts)} + CASE WHEN {found} THEN 0 ELSE log2({alphabet} - coalesce(plain0, 0) + 1) END)"


def scored(targets: str, order: int) -> str:
    """CTE costs(model, ctx, s, bits)."""
    return levels(targets, order) + f",\ncosts AS (SELECT model, ctx, s, {bits(order)} AS bits FROM lv)"


def codelengths(train_source: str, test_source: str, key: str, order: int, sentinel: bool = True) -> str:
    """WITH ... cl(key, model, bits, symbols)."""
    return "WITH " + ",\n".join([
        train(train_source, order),
        symbols("te", test_source, key, order, sentinel),
        f"gc AS (SELECT {key}, {longest(order)} AS ctx, s, count(*) AS n FROM te GROUP BY ALL)",
        scored("SELECT DISTINCT m.model, gc.ctx, gc.s FROM gc, (SELECT DISTINCT model FROM counts) m", order),
        f"cl AS (SELECT {key}, model, sum(n * bits) AS bits, sum(n) AS symbols FROM gc JOIN costs USING (ctx, s) GROUP BY ALL)",
    ])
