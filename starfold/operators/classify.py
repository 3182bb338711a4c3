"""Rule scores, ensemble, physics veto and the fallback classifier, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions.columns import logistic

CLASSES = ("transit", "eclipsing_binary", "blend", "other")
#: Weights of the ensemble's members.
WEIGHTS = {"rules": 0.25, "ml": 1.0, "cnn": 0.75}


def _add(fires: Column, score: Column | float) -> Column:
    return F.when(F.coalesce(fires, F.lit(False)), score).otherwise(0.0)


def rule_scores(m: DataFrame) -> DataFrame:
    """score_<class> for each class from metrics and flags; transit starts at 1, the others at 0.

    The comparisons are those of the rules as given, also where a metric's range
    keeps a rule from firing.
    """
    c = lambda n: F.col(n) if n in m.columns else F.lit(None).cast("double")
    blend = _add(c("crowdsap") < 0.9, 2.6 * logistic(0.9 - c("crowdsap"), 0.2, 0.12)) + _add(c("centroid_offset") > 0, 2.4 * logistic(c("centroid_offset"), 2.0, 1.0)) + _add(F.col("blend_contamination"), 2.0)
    strength = F.when(c("secondary_snr") > 0, c("secondary_snr")).otherwise(5.0)
    eb = _add((c("secondary_snr") >= 3) | (c("secondary_depth") >= 1e-3), 3.0 * logistic(strength, 3.0, 2.0)) + _add(c("implied_rp_rjup") > 2, 2.8 * logistic(c("implied_rp_rjup"), 2.0, 0.6)) + _add(c("odd_even_depth_sigma") >= 3, 2.6 * logistic(c("odd_even_depth_sigma"), 3.0, 1.5))
    shape = F.when(c("v_shape_metric") < 1.5, 1.6 * logistic(1.5 - c("v_shape_metric"), 0.3, 0.4)).when(c("ingress_egress_ratio") > 0.4, 1.2 * logistic(c("ingress_egress_ratio"), 0.4, 0.1)).otherwise(0.0)
    eb = eb + shape + _add(F.col("eb_odd_even") | F.col("eb_secondary") | F.col("eb_vshape"), 1.8)
    far = F.when(c("stellar_density_ratio") > 0, F.abs(F.log10(c("stellar_density_ratio"))))
    other = _add(c("sweet_metric") >= 3, 2.6 * logistic(c("sweet_metric"), 3.0, 2.0)) + _add(c("transit_snr") < 7.1, 2.2 * logistic(7.1 - c("transit_snr"), 2.0, 2.0)) + _add(far > math.log10(5), 1.6 * logistic(far, math.log10(5), 0.4)) + _add(F.col("other_variability"), 1.6)
    return m.withColumns({"score_transit": F.lit(1.0), "score_eclipsing_binary": eb, "score_blend": blend, "score_other": other})


def softmax(m: DataFrame) -> DataFrame:
    top = F.greatest(*(F.col(f"score_{k}") for k in CLASSES))
    raw = {k: F.exp(F.col(f"score_{k}") - top) for k in CLASSES}
    total = sum(raw.values(), F.lit(0.0))
    return m.withColumns({f"prob_{k}": v / total for k, v in raw.items()})


def mixed(members: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """Weighted mean of the members' probabilities; members that are null weigh nothing."""
    weight = {k: F.when(p[CLASSES[0]].isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, p in members.items()}
    total = sum(weight.values(), F.lit(0.0))
    return {c: sum((weight[k] * F.coalesce(p[c], F.lit(0.0)) for k, p in members.items()), F.lit(0.0)) / F.when(total > 0, total) for c in CLASSES}


def veto(m: DataFrame) -> DataFrame:
    """Blend first, then eclipsing binary: the class is raised to 0.9 at least, the others keep their proportions."""
    c = lambda n: F.col(n) if n in m.columns else F.lit(None).cast("double")
    is_blend = F.coalesce(F.col("blend_contamination") | ((c("crowdsap") < 0.5) & (c("centroid_offset") >= 2)), F.col("blend_contamination"))
    second = F.coalesce(F.col("eb_secondary") | (F.coalesce(c("secondary_snr"), F.lit(0.0)) >= 5) | (F.coalesce(c("secondary_depth"), F.lit(0.0)) >= 5e-3), F.lit(False))
    is_eb = second | F.col("implied_radius_too_big") | (F.coalesce(c("implied_rp_rjup"), F.lit(0.0)) > 2.5) | (F.coalesce(c("odd_even_depth_sigma"), F.lit(0.0)) >= 5)
    forced = F.when(is_blend, "blend").when(is_eb, "eclipsing_binary")
    out = m.withColumn("forced", forced)
    own = F.coalesce(*(F.when(F.col("forced") == k, F.col(f"prob_{k}")) for k in CLASSES))
    raised = F.greatest(own, F.lit(0.9))
    rest = 1 - own
    moved = {}
    for k in CLASSES:
        p = F.col(f"prob_{k}")
        moved[f"prob_{k}"] = F.when(F.col("forced").isNull(), p).when(F.col("forced") == k, raised).otherwise(F.when(rest > 0, p / rest * (1 - raised)).otherwise((1 - raised) / 3))
    return out.withColumns(moved)


def labelled(m: DataFrame) -> DataFrame:
    """The class of the highest probability; ties go to the first in the order of ``CLASSES``."""
    top = F.greatest(*(F.col(f"prob_{k}") for k in CLASSES))
    label = None
    for k in CLASSES:
        hit = F.col(f"prob_{k}") == top
        label = F.when(hit, k) if label is None else label.when(hit, k)
    return m.withColumns({"class": label, "confidence": top})


def fallback(m: DataFrame) -> DataFrame:
    """By flags alone: eclipsing binary, then blend, then transit if significant, else other; 0.7 for it, 0.1 for each other."""
    any_eb = F.col("eb_odd_even") | F.col("eb_secondary") | F.col("eb_vshape") | F.col("implied_radius_too_big")
    label = F.when(any_eb, "eclipsing_binary").when(F.col("blend_contamination"), "blend").when(F.coalesce(F.col("transit_snr") >= 7, F.lit(False)), "transit").otherwise("other")
    return m.withColumn("class", label).withColumns({f"prob_{k}": F.when(F.col("class") == k, 0.7).otherwise(0.1) for k in CLASSES})


def fit_gate(m: DataFrame, least_snr: float = 7.0) -> DataFrame:
    """Which stars are worth a fit: a period, and a transit by class, or by signal and probability."""
    gate = (F.col("class") == "transit") | ((F.col("transit_snr") >= max(least_snr, 1.0)) & (F.col("prob_transit") >= 0.25))
    return m.withColumn("fits", F.coalesce(gate, F.lit(False)))
