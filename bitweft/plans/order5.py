"""Identification and evaluation at the toolkit's default order, 5, over all rows (two folds where the text is held out).

SQL at this order is too slow; tests compare the costs with the adaptive model, trained and then frozen."""

from __future__ import annotations

from bitweft.plans import coding, folds, scoring
from bitweft.plans.base import query

ORDER = 5


@query()
def lang_id_static_o5(spark, sf):
    """Language identification of every document."""
    return scoring.of_lang_id_static(*folds.language_costs(spark, sf, ORDER))


@query()
def lang_id_precision_o5(spark, sf):
    """Precision at the first rank over every document."""
    return scoring.of_lang_id_precision(*folds.language_costs(spark, sf, ORDER))


@query()
def lang_confusion_o5(spark, sf):
    """Precision and recall of each class over every document."""
    return scoring.of_lang_confusion(*folds.language_costs(spark, sf, ORDER))


@query()
def lang_bits_matrix_o5(spark, sf):
    """Cost of every document under every model of the other half."""
    return scoring.of_lang_bits_matrix(*folds.language_costs(spark, sf, ORDER))


@query()
def bits_json_o5(spark, sf):
    """JSON object of bits by model for every document."""
    return scoring.of_bits_json(*folds.language_costs(spark, sf, ORDER))


@query()
def role_id_conversations_o5(spark, sf):
    """Who speaks, for every turn."""
    return scoring.of_role_id_conversations(*folds.role_costs(spark, sf, ORDER))


@query()
def toxic_id_labels_o5(spark, sf):
    """Binary identification of every labelled document."""
    return scoring.of_toxic_id_labels(*folds.toxic_costs(spark, sf, ORDER))


@query()
def line_bits_max_o5(spark, sf):
    """Cost of each line on its own: mean and maximum of each text."""
    return scoring.of_line_bits_max(spark, sf, ORDER)


@query()
def language_markup_o5(spark, sf):
    """Which language's model each character of a turn is cheapest under, switching at spaces."""
    return coding.of_language_markup(spark, sf, ORDER)
