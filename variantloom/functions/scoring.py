"""Column helpers for scores, calls and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from variantloom.contract import LOW_CONFIDENCE

# weights of the built-in transparent scorer, used where no trained model is supplied
FORMULA_INTERCEPT = -2.0
FORMULA_WEIGHTS = {
    "CADD": 0.08,
    "PolyPhen": 1.2,
    "SIFT": -0.9,
    "rare_variant": 0.6,
    "Is_Frameshift": 1.5,
    "Impact_Score": 0.15,
    "ALT_FREQ": -3.0,
}


def formula_probability() -> Column:
    """Logistic score over contract features; a plain expression, so it stays in codegen."""
    z = F.lit(FORMULA_INTERCEPT)
    for name, weight in FORMULA_WEIGHTS.items():
        z = z + F.lit(weight) * F.col(name).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clipped_probability(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def confidence(p: Column) -> Column:
    return F.coalesce(F.greatest(p, F.lit(1.0) - p), F.lit(0.5))


def call_label(prediction: Column) -> Column:
    return F.when(prediction == 1, "PATHOGENIC").when(prediction.isNotNull(), "BENIGN")


def triage_label(label: Column, p: Column, conf: Column) -> Column:
    pathogenic = label == "PATHOGENIC"
    return (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(conf, F.lit(0.0)) < LOW_CONFIDENCE, "Insufficient evidence")
        .when(pathogenic & (F.coalesce(p, F.lit(0.0)) >= 0.75), "High priority")
        .when(pathogenic, "Review priority")
        .otherwise("Low priority")
    )


def confidence_band(conf: Column) -> Column:
    return (
        F.when(conf.isNull(), "Unknown").when(conf >= 0.85, "High").when(conf >= 0.6, "Moderate").otherwise("Low")
    )


def percent_text(p: Column, digits: int = 3) -> Column:
    return F.when(p.isNotNull(), F.format_string(f"%.{digits}f", p * 100)).otherwise("")


def _driver(order: int, name: str, value: Column, direction: Column, strength: Column) -> Column:
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(8.0), strength))
    # sort keys first: strongest first, then the fixed order of the four scores
    item = F.struct(
        (-bounded).alias("sort_key"),
        F.lit(order).alias("sort_order"),
        F.lit(name).alias("name"),
        direction.alias("direction"),
        bounded.alias("strength"),
    )
    return F.when(value.isNotNull(), item)


def evidence_drivers(sift: Column, polyphen: Column, cadd: Column, alt_freq: Column, k: int = 4) -> Column:
    """The ``k`` strongest score drivers of one variant, as an array of structs (no shuffle)."""
    drivers = [
        _driver(
            0, "CADD", cadd,
            F.when(cadd >= 20, "Raises concern").when(cadd >= 10, "Moderate signal").otherwise("Lower signal"),
            cadd / 35 * 100,
        ),
        _driver(
            1, "ALT frequency", alt_freq,
            F.when(alt_freq < 0.001, "Rare variant").when(alt_freq < 0.01, "Uncommon").otherwise("Commoner allele"),
            (1 - F.least(alt_freq, F.lit(0.02)) / 0.02) * 100,
        ),
        _driver(
            2, "SIFT", sift,
            F.when(sift <= 0.05, "Damaging signal").otherwise("Tolerated signal"),
            (1 - sift) * 100,
        ),
        _driver(
            3, "PolyPhen", polyphen,
            F.when(polyphen >= 0.85, "Probably damaging")
            .when(polyphen >= 0.45, "Possibly damaging")
            .otherwise("Benign leaning"),
            polyphen * 100,
        ),
    ]
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*drivers))), 1, k)
    return F.transform(
        ranked, lambda d: F.struct(d["name"].alias("name"), d["direction"].alias("direction"), d["strength"].alias("strength"))
    )
