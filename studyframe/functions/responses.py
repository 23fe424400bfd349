"""Scalar response, unit and residual functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and typical constants.
CAFFEINE_UM_TO_MGL = 0.19419
TERIPARATIDE_UG_TO_PMOL = 1e6 / 4117.8
GFR_ML_MIN_PER_L_H = 16.667
PTH_PM_TO_PGML = 9.4
INHIBITION_EC50 = 5.8257
PLASMA_VOLUME_L = 14.0


def conc_to_amount(conc: Column, volume: Column) -> Column:
    """Concentration times sample volume, or plasma volume where none was measured."""
    return conc * F.coalesce(volume, F.lit(PLASMA_VOLUME_L))


def sigmoid_emax(conc: Column, emax, ec50, hill) -> Column:
    top, mid, slope = (c if isinstance(c, Column) else F.lit(float(c)) for c in (emax, ec50, hill))
    return top * F.pow(conc, slope) / (F.pow(mid, slope) + F.pow(conc, slope))


def emax_inhibition(conc: Column, emax, ec50: float = INHIBITION_EC50) -> Column:
    """Fraction left after inhibition by ``conc``."""
    return 1 - emax * conc / (conc + ec50)


def um_to_mgl(conc: Column) -> Column:
    return conc * CAFFEINE_UM_TO_MGL


def ug_to_pmol(dose: Column) -> Column:
    return dose * TERIPARATIDE_UG_TO_PMOL


def gfr_to_ml_min(gfr: Column) -> Column:
    return gfr * GFR_ML_MIN_PER_L_H


def gfr_to_l_h(gfr: Column) -> Column:
    return gfr / GFR_ML_MIN_PER_L_H


def pm_to_pgml(conc: Column) -> Column:
    return conc * PTH_PM_TO_PGML


def signif(x: Column, digits: int = 3) -> Column:
    """Round to significant digits; zero stays zero, null stays null."""
    power = F.floor(F.log10(F.abs(x))) - (digits - 1)
    up, down = F.pow(F.lit(10.0), -power), F.pow(F.lit(10.0), power)
    # scale by an exact power of ten on whichever side is whole
    scaled = F.when(power < 0, F.round(x * up) / up).otherwise(F.round(x / down) * down)
    return F.when(x == 0, F.lit(0.0)).otherwise(scaled)


def proportional_error(pred: Column, eps: Column, lloq: float) -> Column:
    return pred * (1 + eps) + lloq


def exponential_error(pred: Column, eps: Column) -> Column:
    return pred * F.exp(eps)


def percent_of(value: Column, baseline: Column) -> Column:
    """Percent of baseline; null where the baseline is zero."""
    return 100 * value / F.nullif(baseline, F.lit(0.0))


def concentration(amount: Column, volume: Column) -> Column:
    return amount / volume


def residual(obs: Column, pred: Column) -> Column:
    return obs - pred


def log_residual(obs: Column, pred: Column) -> Column:
    """Difference of natural logs; null unless both are positive."""
    return F.ln(obs) - F.ln(pred)


def prediction_correct(y: Column, smoothed_pred: Column, pred: Column) -> Column:
    """Prediction-corrected value; null where the prediction is zero."""
    return y * smoothed_pred / F.nullif(pred, F.lit(0.0))
