"""Published parameter sets of the linear caffeine models.

Fixed values: typical values, initial amounts (mg), between-subject variances (omega,
by ETA number) and residual variances (sigma), as published.
"""

from __future__ import annotations

from dataclasses import replace

from studyframe.functions.kernel import LinearModel

_ORAL_ETAS = {1: "KA", 2: "K12", 3: "K21", 4: "V1", 5: "V2", 6: "TLAG",
              7: "CLCAPX", 8: "CLCAO", 9: "CLPX"}

ORAL_ABSTINENT = LinearModel(
    typical={"KA": 3.65, "K12": 1.71, "K21": 2.02, "V1": 31.2, "V2": 24.4,
             "TLAG": 0.15, "CLCAPX": 2.73, "CLCAO": 4.86, "CLPX": 3.81},
    etas=_ORAL_ETAS,
    omega={1: 1.060900, 2: 0.105625, 3: 0.053361, 4: 0.031329, 5: 0.060516,
           6: 1.144900, 7: 0.051529, 8: 0.326041, 9: 0.017956,
           10: 5.244100, 11: 0.232324},
    initial={"GUT": 1.37, "CENT": 1.72, "PERI": 1.20, "PARA": 4.06},
    initial_etas={10: "CENT", 11: "PARA"},
    eliminated="(CLCAPX + CLCAO) / V1", k12="K12", k21="K21", lag="TLAG",
    metabolites={"PARA": ("CLCAPX / V1", "CLPX / V2", "V2")},
    sigma={"CA": 0.02, "PX": 0.04},
)

ORAL_HABITUAL = replace(
    ORAL_ABSTINENT,
    typical={"KA": 3.55, "K12": 1.54, "K21": 2.40, "V1": 27.7, "V2": 18.4,
             "TLAG": 0.14, "CLCAPX": 2.63, "CLCAO": 3.70, "CLPX": 3.74},
    omega={1: 0.313600, 2: 0.391876, 3: 0.088209, 4: 0.040804, 5: 0.138384,
           6: 0.659344, 7: 0.038416, 8: 0.463761, 9: 0.011881,
           10: 3.496900, 11: 1.060900},
    initial={"GUT": 1.18, "CENT": 3.40, "PERI": 1.21, "PARA": 6.93},
    sigma={"CA": 0.07, "PX": 0.04},
)

GUM = replace(ORAL_ABSTINENT, typical={**ORAL_ABSTINENT.typical, "KA": 3.95}, fraction=0.77)

INHALED = LinearModel(
    typical={"KA": 3.55, "V1": 76.2, "CL": 8.37, "V2": 214.0, "Q": 9.74,
             "FPX": 0.0288, "KPX": 0.308, "FTP": 0.00342, "KTP": 0.313,
             "FTB": 0.00537, "KTB": 0.117},
    etas={1: "KA", 2: "V1", 3: "CL", 4: "FPX", 5: "FTP", 6: "FTB"},
    omega={1: 0.313600},
    omega_blocks=(
        ((2, 3), ((0.269361, 0.122723), (0.122723, 0.316969))),
        ((4, 5, 6), ((0.429025, 0.312147, 0.446710),
                     (0.312147, 0.414736, 0.662805),
                     (0.446710, 0.662805, 1.537600)))),
    bioavailability={"V1": 0.6, "CL": 0.6, "V2": 0.6, "Q": 0.6},
    initial={"GUT": 0.0, "CENT": 0.0, "PERI": 0.0, "PARA": 0.0, "THPH": 0.0, "THBR": 0.0},
    eliminated="CL / V1", k12="Q / V1", k21="Q / V2",
    metabolites={"PARA": ("CL * FPX", "KPX", "V1"), "THPH": ("CL * FTP", "KTP", "V1"),
                 "THBR": ("CL * FTB", "KTB", "V1")},
    sigma={"CA": 0.068644, "PX": 0.045369, "TP": 0.049284, "TB": 0.051076},
    exponential_residual=True, lloq=0.0,
)
# Analyte code of each measured compartment.
ANALYTES = {"CENT": "CA", "PARA": "PX", "THPH": "TP", "THBR": "TB"}
