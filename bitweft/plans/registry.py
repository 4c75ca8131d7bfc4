"""All queries of the library and the SQL that states their results."""

from bitweft.plans import coding, folds, models, order5, scoring, texts, word_bundles  # noqa: F401  registers
from bitweft.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "lang_id_static"
