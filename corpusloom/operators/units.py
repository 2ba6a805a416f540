"""Quantities recorded in different units, brought to one unit per quantity.

Each known unit of a quantity is an affine map ``common = a * x + b``.  Where
the unit is missing or unreliable, a log-scale mixture per quantity decides:
its components share one location and spread in the common unit and are
offset by the known conversion factors, so a component *is* a unit.  The
mixture is fitted by EM over a histogram of all rows; each row then takes the
unit of highest posterior given its printed unit, its value, its printed
reference range and the grid on which the common values lie.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grams, moles, equivalents or cells per litre of each unit in normal form.
MASS = {
    "g/dl": 10.0, "g/l": 1.0, "g/ml": 1e3, "mg/dl": 1e-2, "mg/l": 1e-3, "mg/ml": 1.0, "ug/dl": 1e-5,
    "ug/l": 1e-6, "ug/ml": 1e-3, "ng/dl": 1e-8, "ng/l": 1e-9, "ng/ml": 1e-6, "pg/ml": 1e-9, "pg/dl": 1e-11,
}
MOLAR = {"mol/l": 1.0, "mmol/l": 1e-3, "umol/l": 1e-6, "nmol/l": 1e-9, "pmol/l": 1e-12, "mmol/dl": 1e-2, "umol/dl": 1e-5}
EQUIV = {"meq/l": 1e-3, "eq/l": 1.0}
COUNT = {"/ul": 1e6, "k/ul": 1e9, "lakh/ul": 1e11, "mill/ul": 1e12, "10^9/l": 1e9, "10^12/l": 1e12, "10^6/l": 1e6, "10^3/ul": 1e9, "10^6/ul": 1e12}
FRACTION = {"%": 0.01, "l/l": 1.0}
# Charge of the ions reported in equivalents.
VALENCE = {"Serum Sodium": 1, "Serum Calcium": 2, "Serum Potassium": 1, "Serum Chloride": 1, "Serum Magnesium": 2}
# Master equation between NGSP (%) and IFCC (mmol/mol) HbA1c.
NGSP_SLOPE, NGSP_OFFSET = 0.09148, 2.152

UNIT_PATTERN = (
    r"(?i)(?:mmol\s*/\s*mol|(?:milli|micro|nano|pico|[mnpuµμ])?mol\s*/\s*d?l|m?eq\s*/\s*l"
    r"|(?:mgs?|gms?|g|mcg|[uµμ]g|ng|pg)\s*/\s*(?:dl|ml|l)|(?:mgs?|gms?|g|vol)\s*%|%|\bpercent\b"
    r"|x?\s*10\s*[\^*]?\s*(?:12|[3693³⁹⁶])\s*/\s*(?:l|[uµμ]l|cumm|cmm|mm3)"
    r"|(?:cells|lakhs?|lacs?|thou(?:sand)?|k|mill(?:ion)?|m)?\s*/\s*(?:cumm|cu\s*mm|cmm|mm3|mm³|[uµμ]l)"
    r"|\bl\s*/\s*l\b|\bratio\b|\b[np]M\b)"
)


#: Rewrites, in order, that bring a lower-case spelling without blanks, dots, ``^`` and ``*`` to normal form.
SPELLINGS = [
    (r"^x10", "10"), (r"^10(12|[369])(?=/)", "10^$1"), (r"^mgs", "mg"), (r"^gms?(?=[/%])", "g"), (r"^mcg", "ug"),
    (r"^milli(?=mol)", "m"), (r"^micro(?=mol)", "u"), (r"^nano(?=mol)", "n"), (r"^pico(?=mol)", "p"),
    (r"^([np])m$", "$1mol/l"), (r"(cumm|cmm|mm3)$", "ul"), (r"^cells", ""), (r"^(lakhs?|lacs?)", "lakh"),
    (r"^(thou(sand)?|10\^3)(?=/ul)", "k"), (r"^(million|mill|m|10\^6)(?=/ul)", "mill"),
    (r"^(m?g)%$", "$1/dl"), (r"^(percent|vol%|%ngsp|%\(ngsp\))$", "%"), (r"^ratio$", "l/l"), (r"^mmol/mol.*$", "mmol/mol"),
]


def normal_unit(u: str) -> str:
    """A unit's spelling brought to normal form; empty where nothing is written."""
    s = re.sub(r"[\s .^*]", "", u.translate(str.maketrans("µμ³⁹⁶¹²", "uu39612")).lower())
    for a, b in SPELLINGS:
        s = re.sub(a, b.replace("$", "\\"), s)
    return s


@dataclass(frozen=True)
class Component:
    """One unit of one quantity: ``common = slope * x + offset``; ``keys`` are its spellings in normal form."""

    slope: float
    offset: float
    keys: tuple[str, ...]


def components(test: str, common: str, molar_mass: float | None) -> list[Component]:
    """The distinct conversions into ``common`` known for a quantity; units that give the same number are one."""
    if test == "HbA1c":
        return [Component(1.0, 0.0, ("%",)), Component(NGSP_SLOPE, NGSP_OFFSET, ("mmol/mol",)), Component(100.0, 0.0, ("l/l",))]
    common = normal_unit(common)
    m = molar_mass if molar_mass and molar_mass == molar_mass and molar_mass > 0 else None
    grams: dict[str, float] = {}
    if common in MASS or common in MOLAR or common in EQUIV:
        grams |= MASS if common in MASS or m else {}
        one = m or 1.0
        grams |= {k: v * one for k, v in MOLAR.items()} if m or common in MOLAR else {}
        if (m or common in EQUIV or common in MOLAR) and test in VALENCE:
            grams |= {k: v * one / VALENCE[test] for k, v in EQUIV.items()}
    elif common in COUNT:
        grams = dict(COUNT)
    elif common in FRACTION:
        grams = dict(FRACTION)
    base = grams.get(common)
    if not base:
        return [Component(1.0, 0.0, (common,))]
    by: dict[float, list[str]] = {}
    for k, g in grams.items():
        by.setdefault(float(f"{g / base:.9g}"), []).append(k)
    return [Component(f, 0.0, tuple(sorted(ks))) for f, ks in sorted(by.items())]


#: A dimension table of quantities larger than this is refused rather than collected.
MAX_QUANTITIES = 5000
#: Spellings of quantities up to this many are broadcast, more are joined by a shuffle.
MAX_NAMES = 100_000
#: Share of printed units taken to be right at first (then estimated within TRUST_RANGE), and of values taken to lie on the grid.
TRUST_LABEL, TRUST_RANGE, TRUST_GRID = 0.97, (0.9, 0.999), 0.9
#: Printed decimals are told apart up to this many.
MAX_DECIMALS = 6
#: Standard deviation (in log10) of a printed reference range about the typical one, and the most it may count.
RANGE_SD, RANGE_FLOOR = 0.02, -25.0
BINS_PER_DECADE = 50
UNCERTAIN_BELOW = 0.9


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _quantities(lab_units: DataFrame) -> list:
    rows = lab_units.limit(MAX_QUANTITIES + 1).collect()
    if len(rows) > MAX_QUANTITIES:
        raise ValueError(f"more than {MAX_QUANTITIES} quantities: not a dimension table")
    return [r for r in rows if r["test_name_standardized"] and r["common_unit"]]


def _prepared(results: DataFrame, quantities: list, key: str) -> DataFrame:
    """Per result: quantity, printed number and decimals, unit key with its place, printed range."""
    spark = results.sparkSession
    names: dict[str, str] = {}
    for q in quantities:
        for a in [q["test_name_standardized"], *(q["aliases"] or [])]:
            if a and a.strip():
                names.setdefault(a.strip().lower(), q["test_name_standardized"])
    alias = spark.createDataFrame(list(names.items()) or [("", "")], "name_key string, quantity string")
    bare = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")))
    lead = r"^\s*[<>=≤≥]*\s*\d[\d,]*(?:\.\d+)?"
    unit_in = lambda c: F.nullif(F.regexp_extract(c, UNIT_PATTERN, 0), F.lit(""))
    text, name, stored = F.coalesce(F.col("raw_text"), F.lit("")), F.coalesce(F.col("test_name"), F.lit("")), F.coalesce(F.col("value_raw"), F.lit(""))
    base = results.select(
        F.col(key).alias("key"), F.when(~F.isnan(F.col("value")), F.col("value")).alias("held"), name.alias("name"), stored.alias("stored"), _filled(F.col("unit")).alias("unit"),
        F.coalesce(bare(_filled(F.col("test_name_standardized"))), bare(name)).alias("name_key"), F.coalesce(F.col("reference_range"), F.lit("")).alias("range"), "ref_low", "ref_high",
        F.when(F.startswith(F.lower(text), F.lower(name)), F.substring(text, F.length(name) + 1, F.length(text))).otherwise(text).alias("rest"),
    )
    base = base.withColumn("raw", F.when(F.col("stored").rlike(r"\d"), F.col("stored")).when(F.trim("stored") == "", F.col("rest")))
    base = base.withColumn(
        "spelling",
        F.coalesce("unit", unit_in(F.regexp_replace("stored", lead, "")), unit_in(F.regexp_extract("name", r"\(([^()]*)\)\s*$", 1)), unit_in(F.col("range")), unit_in(F.regexp_replace("rest", lead, ""))),
    ).withColumn("ends", F.regexp_extract_all("range", F.lit(r"(\d[\d,]*(?:\.\d+)?)(?![\d^*]*/)"), F.lit(1))).withColumn("printed", F.regexp_extract("raw", r"^[^\d]*?(\d[\d,]*(?:\.\d+)?|\.\d+)", 1))
    end = lambda i: F.regexp_replace(F.get("ends", F.lit(i)), ",", "").try_cast("double")
    two, number = F.size("ends") >= 2, F.regexp_replace("printed", ",", "").try_cast("double")
    clean = base.select(
        "key", "name_key", "held", F.coalesce(number, "held").alias("number"), F.when(number.isNotNull(), F.length(F.regexp_extract("printed", r"\.(\d+)", 1))).alias("decimals"),
        "spelling", F.when(F.col("unit").isNotNull(), "unit").when(F.col("spelling").isNotNull(), "text").alias("given_in"),
        F.coalesce(F.when(two, end(0)), "ref_low").alias("low"), F.coalesce(F.when(two, end(1)), "ref_high").alias("high"),
    )
    return clean.join(F.broadcast(alias) if len(names) <= MAX_NAMES else alias, "name_key")


def _fit(cells: list, quantities: list, comps: dict[str, list[Component]]) -> dict[str, tuple]:
    """EM over histogram cells (quantity, label, decimals, bin, n): per quantity location, spread, share of
    right labels, unit weights and, per unit, the log shares of printed decimals (-1 to MAX_DECIMALS)."""
    out = {}
    by: dict[str, list] = {}
    for c in cells:
        by.setdefault(c["quantity"], []).append(c)
    for q in quantities:
        t = q["test_name_standardized"]
        cs, own = comps[t], by.get(t, [])
        lo, hi = q["typical_low"] or 0.0, q["typical_high"] or 0.0
        mu, sd = (math.log10(math.sqrt(lo * hi)), max(0.05, math.log10(hi / lo) / 2)) if lo > 0 and hi > lo else (None, 0.5)
        w, trust = np.full(len(cs), 1.0 / len(cs)), TRUST_LABEL
        shares = np.full((len(cs), MAX_DECIMALS + 2), 1.0 / (MAX_DECIMALS + 2))
        if own:
            dec = np.array([c["decimals"] for c in own]) + 1
            places = np.eye(MAX_DECIMALS + 2)[dec]
            x = 10 ** ((np.array([c["bin"] for c in own]) + 0.5) / BINS_PER_DECADE)
            n = np.array([c["n"] for c in own], float)
            label = np.array([c["label"] for c in own])
            a, b = np.array([c.slope for c in cs]), np.array([c.offset for c in cs])
            common = a * x[:, None] + b
            z, jac = np.log10(common), np.log(a * x[:, None] / common)
            given = np.zeros((len(own), len(cs)))
            given[np.arange(len(own))[label >= 0], label[label >= 0]] = 1.0
            mu = float(np.average(z[:, 0], weights=n)) if mu is None else mu
            for _ in range(40):
                prior = np.where(label[:, None] >= 0, trust * given + (1 - trust) * w, w)
                lp = np.log(np.maximum(prior, 1e-12)) - 0.5 * ((z - mu) / sd) ** 2 - math.log(sd) + jac + np.log(shares[:, dec].T)
                r = np.exp(lp - lp.max(1, keepdims=True))
                r *= (n / r.sum(1))[:, None]
                mu = float((r * z).sum() / r.sum())
                sd = float(np.clip(math.sqrt((r * (z - mu) ** 2).sum() / r.sum()), 0.02, 0.6))
                w = (r.sum(0) + 0.5) / (r.sum() + 0.5 * len(cs))
                trust = float(np.clip(((r * given).sum() + 97) / (r[label >= 0].sum() + 100), *TRUST_RANGE))
                shares = (r.T @ places + 0.5) / (r.sum(0)[:, None] + 0.5 * (MAX_DECIMALS + 2))
        out[t] = (mu if mu is not None else 0.0, sd, trust, w.tolist(), np.log(shares).tolist())
    return out


def convert_units(results: DataFrame, lab_units: DataFrame, key: str = "result_id") -> DataFrame:
    """Every result that reports a number for a known quantity, as a number in the quantity's common unit.

    Returns ``key, quantity, held, number, unit_given, given_in, unit_assigned, same_number, common_value,
    common_low, common_high, value_steps, posterior, uncertain``.  ``held`` is the stored value,
    ``same_number`` says that the assigned unit gives the same number as the common one, ``uncertain``
    marks a posterior below ``UNCERTAIN_BELOW``.

    Runs two small actions: it collects ``lab_units`` (refused beyond MAX_QUANTITIES rows) and one histogram
    over all rows, of at most quantities x (units + 1) x bins cells whatever the number of rows.

    Zero and negative numbers take their printed unit (posterior 1), else the common one (posterior 0, uncertain).
    Rows without a number or of unknown quantity give no row; repeated rows are converted each; an empty table gives an empty one; other columns of the input are ignored.
    """
    quantities = _quantities(lab_units)
    names = [q["test_name_standardized"] for q in quantities]
    comps = [components(q["test_name_standardized"], q["common_unit"], q["molar_mass"]) for q in quantities]
    keys = [{k: i for i, c in enumerate(cs) for k in c.keys} for cs in comps]
    place = {t: i for i, t in enumerate(names)}

    def labels(quantity: pd.Series, spelling: pd.Series) -> tuple[np.ndarray, np.ndarray, pd.Series]:
        """Per row the quantity's number, the label's unit number (-1 if none is known) and the unit's normal form."""
        q = quantity.map(place).to_numpy(np.int64)
        codes, spelled = pd.factorize(spelling)
        forms = np.array([normal_unit(x) for x in spelled] + [""], dtype=object)[codes]
        pairs, inv = np.unique(q * (len(spelled) + 1) + codes + 1, return_inverse=True)
        known = np.array([keys[p // (len(spelled) + 1)].get(normal_unit(spelled[p % (len(spelled) + 1) - 1]), -1) if p % (len(spelled) + 1) else -1 for p in pairs], np.int64)
        return q, (known[inv] if len(pairs) else np.zeros(0, np.int64)), pd.Series(forms)

    @F.pandas_udf("int")
    def label_of(quantity: pd.Series, spelling: pd.Series) -> pd.Series:
        return pd.Series(labels(quantity, spelling)[1])

    # no filter on the number here: it would be evaluated from the texts a second time, beneath the projection
    rows = _prepared(results, quantities, key)
    near = F.least(F.coalesce("decimals", F.lit(-1)), F.lit(MAX_DECIMALS))
    bins = F.floor(F.log10(F.when(F.col("number") > 0, F.col("number"))) * BINS_PER_DECADE)
    cells = rows.groupBy("quantity", "spelling", near.alias("decimals"), bins.alias("bin")).agg(F.count("*").alias("n"))
    cells = cells.groupBy("quantity", label_of("quantity", "spelling").alias("label"), "decimals", "bin").agg(F.sum("n").alias("n")).collect()
    cells = [c for c in cells if c["bin"] is not None]
    model = _fit(cells, quantities, dict(zip(names, comps)))
    width = max([len(cs) for cs in comps], default=1)
    table = lambda f, fill: np.array([[f(i, k) if k < len(cs) else fill for k in range(width)] for i, cs in enumerate(comps)], float).reshape(len(comps), width)
    slope, offset = table(lambda i, k: comps[i][k].slope, 1.0), table(lambda i, k: comps[i][k].offset, 0.0)
    weight = table(lambda i, k: math.log(max(model[names[i]][3][k], 1e-12)), -1e9)
    decimal = np.array([[model[names[i]][4][k] if k < len(cs) else [0.0] * (MAX_DECIMALS + 2) for k in range(width)] for i, cs in enumerate(comps)], float).reshape(len(comps), width, MAX_DECIMALS + 2)
    mu, sd, trust = (np.array([model[t][n] for t in names], float) for n in range(3))
    low0, high0, step0 = (np.array([q[c] or 0.0 for q in quantities], float) for c in ("typical_low", "typical_high", "step"))
    units = np.array([[cs[k].keys[0] if k < len(cs) else "" for k in range(width)] for cs in comps], dtype=object).reshape(len(comps), width)

    @F.pandas_udf("unit_given string, unit_assigned string, a double, b double, posterior double")
    def assign(quantity: pd.Series, spelling: pd.Series, number: pd.Series, decimals: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        q, label, forms = labels(quantity, spelling)
        x, lo, hi = (s.to_numpy(float)[:, None] for s in (number, low, high))
        a, b = slope[q], offset[q]
        with np.errstate(all="ignore"):
            common = a * x + b
            given = np.zeros_like(a)
            given[np.arange(len(q))[label >= 0], label[label >= 0]] = 1.0
            prior = np.where(label[:, None] >= 0, trust[q][:, None] * given + (1 - trust[q])[:, None] * np.exp(weight[q]), np.exp(weight[q]))
            lp = np.log(np.maximum(prior, 1e-300)) - 0.5 * ((np.log10(common) - mu[q][:, None]) / sd[q][:, None]) ** 2 + np.log(a * x / common)
            d = decimals.to_numpy(float)
            lp += np.take_along_axis(decimal[q], np.minimum(np.where(np.isnan(d), -1, d), MAX_DECIMALS).astype(int)[:, None, None] + 1, 2)[:, :, 0]
            t_lo, t_hi, step = low0[q][:, None], high0[q][:, None], step0[q][:, None]
            off = np.maximum(np.abs(np.log10((a * lo + b) / t_lo)), np.abs(np.log10((a * hi + b) / t_hi)))
            lp += np.where((lo > 0) & (hi > lo) & (t_lo > 0) & (t_hi > 0), np.maximum(RANGE_FLOOR, -0.5 * (off / RANGE_SD) ** 2), 0.0)
            reach = np.maximum(0.02, 0.525 * 10.0 ** -d[:, None] * a / step)
            miss = np.abs(common / step - np.round(common / step))
            grid = np.where(reach >= 0.5, 0.0, np.where(miss <= reach, np.log(TRUST_GRID / (2 * reach) + 1 - TRUST_GRID), math.log(1 - TRUST_GRID)))
            lp += np.where((step > 0) & ~np.isnan(d[:, None]), grid, 0.0)
            lp = np.nan_to_num(lp, nan=-1e9)
            # zero and negative numbers lie outside the mixture: their printed unit decides, else the common one
            flat, absent = x[:, 0] <= 0, np.isnan(x[:, 0])
            lp[flat] = np.where(given[flat] > 0, 0.0, np.where((label[flat, None] < 0) & (a[flat] == 1) & (b[flat] == 0), -1.0, -1e9))
            best = lp.argmax(1)
            at = np.arange(len(q))
            return pd.DataFrame({"unit_given": forms.where(forms != "", None), "unit_assigned": np.where(absent, None, units[q, best]), "a": a[at, best], "b": b[at, best], "posterior": np.where(flat & (label < 0), 0.0, 1 / np.exp(lp - lp.max(1, keepdims=True)).sum(1))})

    assign = assign.asNondeterministic()  # so that filters above are not answered by a second evaluation

    dim = results.sparkSession.createDataFrame([(t, q["step"] or 0.0) for t, q in zip(names, quantities)] or [("", 0.0)], "quantity string, step double")
    scored = rows.withColumn("u", assign("quantity", "spelling", "number", "decimals", "low", "high")).where("u.unit_assigned is not null").join(F.broadcast(dim), "quantity")
    common = F.col("u.a") * F.col("number") + F.col("u.b")
    return scored.select(
        F.col("key").alias(key), "quantity", "held", "number", "u.unit_given", "given_in", "u.unit_assigned", ((F.col("u.a") == 1) & (F.col("u.b") == 0)).alias("same_number"), common.alias("common_value"),
        (F.col("u.a") * F.col("low") + F.col("u.b")).alias("common_low"), (F.col("u.a") * F.col("high") + F.col("u.b")).alias("common_high"),
        F.when(F.col("step") > 0, F.round(common / F.col("step")).cast("long")).alias("value_steps"), "u.posterior", (F.col("u.posterior") < UNCERTAIN_BELOW).alias("uncertain"),
    )


def restated(converted: DataFrame, key: str = "result_id") -> DataFrame:
    """The rows whose stored value is not already the reported number in the common unit: ``key, value_steps``."""
    holds = F.col("held").isNotNull() & F.col("same_number") & (F.abs(F.col("held") - F.col("number")) <= 1e-9 * F.abs(F.col("number")))
    return converted.where(~holds & F.col("value_steps").isNotNull()).select(key, "value_steps").distinct()
