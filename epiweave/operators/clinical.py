"""Scoring of patients in a line list: log-odds, categories, ranked differentials, and an additive second scorer.

All are projections of one row: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the clinical model: prior and log-odds of each feature, in the order in which they add up.
PRIOR = 0.06
WEIGHTS = {
    "fever_high": 0.69, "sore_throat": 1.25, "chest_pain": 1.39, "mucosal_bleeding": 1.79, "facial_edema": 1.61, "proteinuria": 1.61, "hearing_loss": 1.95,
    "headache": 0.41, "myalgia": 0.47, "vomiting": 0.51, "diarrhea": 0.41, "abdominal_pain": 0.53, "duration_7_plus_days": 0.69,
    "rapid_onset_lt_3d": -0.51, "rash_present": -0.51, "jaundice": -0.22,
    "contact_confirmed": 2.30, "contact_rodent": 0.92, "high_risk_lga": 0.69, "hcw_febrile_care": 0.69, "household_illness": 0.51, "travel_endemic": 0.41,
    "age_15_to_49": 0.18, "male_sex": 0.10,
}
#: Competing diagnoses: name, base probability, features that raise it and by how much, features that lower it and by how much.
COMPETITORS = (
    ("Severe malaria", 0.45, ("headache", "myalgia", "vomiting", "fever_high"), 0.06, ("sore_throat", "mucosal_bleeding", "chest_pain", "contact_confirmed"), 0.07),
    ("Typhoid fever (enteric fever)", 0.28, ("abdominal_pain", "diarrhea", "headache", "duration_7_plus_days"), 0.05, ("mucosal_bleeding", "chest_pain", "contact_confirmed", "sore_throat"), 0.06),
    ("Viral hemorrhagic fever (other)", 0.08, ("mucosal_bleeding", "contact_confirmed", "fever_high", "high_risk_lga"), 0.06, ("sore_throat", "rash_present"), 0.04),
    ("Bacterial sepsis", 0.20, ("fever_high", "rapid_onset_lt_3d"), 0.06, ("sore_throat", "contact_confirmed", "high_risk_lga", "duration_7_plus_days"), 0.05),
    ("Meningococcal meningitis", 0.12, ("headache", "myalgia", "rapid_onset_lt_3d"), 0.05, ("sore_throat", "hearing_loss", "contact_confirmed", "abdominal_pain"), 0.05),
    ("Yellow fever", 0.05, ("jaundice", "mucosal_bleeding", "fever_high"), 0.08, ("sore_throat", "hearing_loss", "chest_pain"), 0.03),
    ("Ebola / Marburg (if in outbreak zone)", 0.02, ("mucosal_bleeding", "contact_confirmed", "diarrhea", "household_illness"), 0.10, ("sore_throat", "proteinuria", "hearing_loss"), 0.005),
)
TARGET = "Lassa fever"
CATEGORIES = {"low": ("LOW PROBABILITY", "#22c55e", False), "moderate": ("MODERATE -- CONSIDER TESTING", "#f59e0b", False), "high": ("HIGH -- TEST AND MONITOR", "#f97316", True), "very_high": ("VERY HIGH -- ISOLATE IMMEDIATELY", "#ef4444", True)}
#: Fixed recommendations and actions by category.
ADVICE = {
    "low": (
        "Lassa fever is unlikely based on current presentation. Consider alternative diagnoses.",
        (
            "Continue standard fever workup (malaria RDT, blood culture)",
            "Monitor patient for 48 hours",
            "Reassess if symptoms worsen or new features develop",
            "No isolation required at this probability level",
        ),
    ),
    "moderate": (
        "Clinical features are consistent with Lassa fever. Laboratory testing is recommended.",
        (
            "Collect blood sample for Lassa PCR (RT-PCR)",
            "Use standard barrier precautions while awaiting results",
            "Notify infection control / state epidemiologist",
            "Do NOT administer ribavirin without laboratory confirmation unless critically ill",
            "Continue malaria and typhoid workup concurrently",
        ),
    ),
    "high": (
        "Significant clinical and/or epidemiological risk for Lassa fever. Testing required and enhanced precautions indicated.",
        (
            "Place patient in single room with contact and droplet precautions",
            "Healthcare workers must use full PPE (gown, gloves, N95/FFP2 mask, eye protection)",
            "Collect blood for Lassa PCR IMMEDIATELY -- do not delay",
            "Report to state epidemiologist and NCDC within 24 hours",
            "Consider ribavirin if PCR pending and high clinical suspicion",
            "Do not perform aerosol-generating procedures without enhanced PPE",
        ),
    ),
    "very_high": (
        "Strong clinical and epidemiological features of Lassa fever. Immediate isolation and reporting mandatory.",
        (
            "ISOLATE PATIENT IMMEDIATELY in negative-pressure room if available",
            "Full PPE mandatory for all healthcare contacts -- no exceptions",
            "Activate hospital outbreak protocol",
            "Call NCDC Emergency Line NOW: 0800-970000-10",
            "Collect blood for Lassa PCR STAT",
            "Administer ribavirin empirically -- do not wait for PCR results",
            "Contact trace all healthcare workers who have been exposed",
            "Suspend aerosol-generating procedures until isolation confirmed",
        ),
    ),
}
#: Fixed points of the additive scorer.
POINTS = {
    "fever": 15, "refractory_fever": 20, "sore_throat": 12, "chest_pain": 18, "mucosal_bleeding": 20, "facial_edema": 15, "hearing_loss": 22, "headache": 5, "myalgia": 5, "vomiting": 7, "diarrhea": 5, "abdominal_pain": 6,
    "weakness": 4, "contact_confirmed_case": 30, "contact_rodent": 15, "high_risk_lga": 12, "household_illness": 18,
}
POINTS_STATES = ("Edo", "Ondo", "Bauchi", "Taraba", "Ebonyi")


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def flags() -> dict[str, Column]:
    """The model's features as booleans, null as false."""
    same = {n: n for n in WEIGHTS} | {"rapid_onset_lt_3d": "rapid_onset", "rash_present": "rash", "contact_confirmed": "contact_confirmed_case"}
    derived = {
        "fever_high": F.coalesce(F.col("fever_temp") >= 39.0, F.lit(False)),
        "duration_7_plus_days": F.coalesce(F.col("duration") >= 7, F.lit(False)),
        "age_15_to_49": F.coalesce(F.col("age").between(15, 49), F.lit(False)),
        "male_sex": F.coalesce(F.col("sex") == "male", F.lit(False)),
        "hcw_febrile_care": _true("hcw_febrile_care") | _true("is_hcw"),
    }
    return {n: derived[n] if n in derived else _true(same[n]) for n in WEIGHTS}


def with_flags(patients: DataFrame) -> DataFrame:
    """Adds f_<feature> for every feature of the model."""
    return patients.withColumns({f"f_{n}": c for n, c in flags().items()})


def log_odds() -> Column:
    """Over with_flags: prior log-odds plus the weights of the active features."""
    total = F.lit(math.log(PRIOR / (1 - PRIOR)))
    for n, w in WEIGHTS.items():
        total = total + F.when(F.col(f"f_{n}"), w).otherwise(0.0)
    return total


def scored(patients: DataFrame) -> DataFrame:
    """Adds the flags, log_odds, probability, pct (half-even) and category; without fever 0 and low."""
    out = with_flags(patients).withColumn("log_odds", log_odds())
    out = out.withColumn("probability", F.when(_true("fever"), 1 / (1 + F.exp(-F.col("log_odds")))).otherwise(0.0))
    out = out.withColumn("pct", F.bround(F.col("probability") * 100).cast("int"))
    return out.withColumn("category", category("pct"))


def category(pct: str) -> Column:
    p = F.col(pct)
    return F.when(p <= 25, "low").when(p <= 50, "moderate").when(p <= 75, "high").otherwise("very_high")


def features_active() -> Column:
    """Names and weights of the active features, the heaviest first, equal ones in the model's order; none without fever."""
    every = F.array(*(F.when(F.col(f"f_{n}"), F.struct(F.lit(-abs(w)).alias("o"), F.lit(i).alias("i"), F.lit(n).alias("key"), F.lit(w).alias("weight"))) for i, (n, w) in enumerate(WEIGHTS.items())))
    named = F.transform(F.array_sort(F.filter(every, lambda x: x.isNotNull())), lambda x: F.struct(x["key"].alias("key"), x["weight"].alias("weight")))
    return F.when(_true("fever"), named).otherwise(F.slice(named, 1, 0))


def actions(patients_scored: DataFrame) -> DataFrame:
    """Joins label, colour, isolation, recommendation and list of actions of the category (four rows)."""
    spark = patients_scored.sparkSession
    kinds = "category string, label string, color string, isolate boolean, recommendation string, actions array<string>"
    dim = spark.createDataFrame([(c, *v, ADVICE[c][0], list(ADVICE[c][1])) for c, v in CATEGORIES.items()], kinds)
    return patients_scored.join(F.broadcast(dim), "category")


def competitor_pct(base: float, up: tuple, boost: float, down: tuple, suppress: float) -> Column:
    """Boosts first, each clamped at 0.95, then suppressions, each clamped at 0.01; the expression grows by a term a step."""
    p = F.lit(base)
    for n in up:
        p = F.least(F.lit(0.95), p + F.when(F.col(f"f_{n}"), boost).otherwise(0.0))
    for n in down:
        p = F.greatest(F.lit(0.01), p - F.when(F.col(f"f_{n}"), suppress).otherwise(0.0))
    return F.bround(p * 100).cast("int")


def ranked() -> Column:
    """Over scored: the competitors and the target by pct, the target first among equals; empty without fever."""
    rows = [F.struct((-competitor_pct(b, u, x, d, y)).alias("o"), F.lit(i + 1).alias("i"), F.lit(n).alias("name")) for i, (n, b, u, x, d, y) in enumerate(COMPETITORS)]
    every = F.array_sort(F.array(F.struct((-F.col("pct")).alias("o"), F.lit(0).alias("i"), F.lit(TARGET).alias("name")), *rows))
    named = F.transform(every, lambda x: F.struct(x["name"].alias("name"), (-x["o"]).alias("pct")))
    return F.when(_true("fever"), named).otherwise(F.slice(named, 1, 0))


def points() -> Column:
    """The additive score: base 15, a quarter more in five states, 5 without any input, half-up, at most 95."""
    total = F.lit(15)
    for n, p in POINTS.items():
        total = total + F.when(_true(n), p).otherwise(0)
    unprotected = _true("hcw_febrile_care")
    total = total + F.when(_true("is_hcw") & unprotected, 20).otherwise(0)
    total = F.when(F.col("state").isin(*POINTS_STATES), total * 1.25).otherwise(total.cast("double"))
    given = unprotected
    for n in POINTS:
        given = given | _true(n)
    return F.least(F.floor(F.when(given, total).otherwise(5.0) + 0.5), F.lit(95)).cast("int")


def points_band(score: str = "score") -> Column:
    s = F.col(score)
    return F.when(s < 35, "low").when(s < 60, "moderate").when(s < 80, "high").otherwise("very-high")


def points_differentials(score: str = "score") -> dict[str, Column]:
    s = F.col(score)
    up = lambda c: F.floor(c + 0.5)
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c)).cast("int")
    return {
        "malaria": clamp(up(85 - s * 0.6), 5, 90), "typhoid": clamp(up(40 - s * 0.3), 3, 60), "other_vhf": F.when(s > 40, F.least(F.lit(25), up(s * 0.12))).otherwise(3).cast("int"), "sepsis": clamp(up(25 - s * 0.2), 2, 40),
    }
