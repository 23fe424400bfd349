"""Subject covariates: kidney function and body size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CKD-EPI 2009 coefficients (male, female) and shared terms.
SCR_UMOL_PER_MGDL = 88.4
EXPONENT_MALE, EXPONENT_FEMALE = -0.411, -0.329
KAPPA_MALE, KAPPA_FEMALE = 0.9, 0.7


def ckdepi(secr: Column, age: Column, sex: Column, black: Column, mgdl: bool = False) -> Column:
    """Estimated GFR; ``secr`` in umol/L unless ``mgdl``; sex 1 = male, black 1 = yes."""
    scr = secr if mgdl else secr / SCR_UMOL_PER_MGDL
    male = sex == 1
    ratio = scr / F.when(male, KAPPA_MALE).otherwise(KAPPA_FEMALE)
    exponent = F.when(male, EXPONENT_MALE).otherwise(EXPONENT_FEMALE)
    # null creatinine must stay null: least/greatest alone would skip it
    egfr = (141 * F.pow(F.least(ratio, F.lit(1.0)), exponent)
            * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.209))
            * F.pow(F.lit(0.993), age) * F.pow(F.lit(1.018), 1 - sex)
            * F.pow(F.lit(1.159), black))
    return F.when(secr.isNotNull(), egfr)


def bmi(wt: Column, ht: Column, cm: bool = True) -> Column:
    """Body mass index from kg and cm (or m)."""
    return wt / F.pow(ht / (100.0 if cm else 1.0), F.lit(2.0))


def bsa(wt: Column, ht: Column) -> Column:
    """Body surface area from kg and cm."""
    return 0.007184 * F.pow(ht, F.lit(0.725)) * F.pow(wt, F.lit(0.425))
