"""Word models: training, code length and identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitweft.operators import word_models
from bitweft.plans.base import query
from bitweft.plans.models import turns
from bitweft.plans.scoring import identify


@query(r"""WITH p AS (SELECT conv_id * 1000 + turn AS d, role AS model, regexp_extract_all(coalesce(text, ''), '([^A-Za-z0-9]*[A-Za-z0-9]+|[^A-Za-z0-9]+$)') AS a FROM conversations),
t AS (SELECT d, model, len(a) AS m, unnest(range(0, len(a))) AS pos, unnest([regexp_extract(x, '^([^A-Za-z0-9]*)', 1) FOR x IN a]) AS nonword, unnest([regexp_extract(x, '([A-Za-z0-9]*)$', 1) FOR x IN a]) AS word FROM p),
s AS (SELECT d, model, 'n' AS kind, pos, nonword AS token FROM t UNION ALL SELECT d, model, 'n', m, '<end>' FROM t WHERE pos = m - 1 AND word <> '' UNION ALL SELECT d, model, 'n', 0, '<end>' FROM p WHERE len(a) = 0
  UNION ALL SELECT d, model, 'w', pos, CASE WHEN word = '' THEN '<end>' ELSE word END FROM t),
l AS (SELECT model, kind, token, coalesce(lag(token) OVER (PARTITION BY d, model, kind ORDER BY pos), '<end>') AS before FROM s)
SELECT model, kind, CASE WHEN kind = 'n' AND (contains(before, '. ') OR contains(before, '.' || chr(10)) OR before = '.') THEN '<end>' ELSE before END AS prev, token, count(*) AS n FROM l GROUP BY ALL""")
def word_model_pairs(spark, sf):
    """Training of word models, one per role: counts of tokens in context, of which the tables of tokens are sums."""
    return word_models.train(turns(spark, sf))[0].select("model", "kind", "prev", "token", "n")


@query()
def word_model_id(spark, sf):
    """Role of each turn by word models; each half of the conversations trains the models of the other."""
    t = turns(spark, sf)
    half = [t.where(F.col("conv_id") % 2 == h) for h in (0, 1)]
    costs = [word_models.codelengths(half[h].select("doc", "text"), "doc", word_models.train(half[1 - h])) for h in (0, 1)]
    best = identify(costs[0].unionByName(costs[1]), "doc").join(t.select("doc", F.col("model").alias("role")), "doc")
    return best.select("doc", "role", "predicted", F.round("bits", 4).alias("bits"), "symbols")
