import pytest
from pyspark.sql import functions as F

from daywise.functions.unit_grammar import code_unit, segmentations, unit_code
from daywise.operators.unify_units import readings, recorded_elsewhere, unify_units

COUNT, MASS, TEMP, VOLUME = ("giga_per_L", "kilo_per_uL", "per_uL", "wan_per_uL"), ("g_per_L", "g_per_dL", "mmol_per_L"), ("deg_C", "deg_F", "kelvin"), ("mL", "L", "dL", "fl_oz")
SPELLINGS = [
    ("G/L", COUNT, "giga_per_L"), ("G/L", MASS, "g_per_L"), ("10^9/L", COUNT, "giga_per_L"), ("x10E9/L", COUNT, "giga_per_L"), ("10⁹/L", COUNT, "giga_per_L"), ("Gpt/l", COUNT, "giga_per_L"), ("K/uL", COUNT, "kilo_per_uL"), ("Tsd/µl", COUNT, "kilo_per_uL"), ("thou/mm3", COUNT, "kilo_per_uL"), ("x10³/µL", COUNT, "kilo_per_uL"),
    ("万/μL", COUNT, "wan_per_uL"), ("/mm³", COUNT, "per_uL"), ("cells/uL", COUNT, "per_uL"), ("个/微升", COUNT, "per_uL"), ("grams per litre", MASS, "g_per_L"), ("g·L-1", MASS, "g_per_L"), ("g%", MASS, "g_per_dL"), ("克/分升", MASS, "g_per_dL"), ("mM", MASS, "mmol_per_L"), ("毫摩尔/升", MASS, "mmol_per_L"), ("K", TEMP, "kelvin"), ("℃", TEMP, "deg_C"), ("华氏度", TEMP, "deg_F"),
    ("F", TEMP, "deg_F"), ("cc", VOLUME, "mL"), ("fl. oz.", VOLUME, "fl_oz"), ("分升", VOLUME, "dL"), ("cm", MASS, None), ("?", MASS, None), ("", MASS, None), ("g/L g/L", MASS, None),
]


@pytest.mark.parametrize("text, codes, want", SPELLINGS)
def test_spellings(text, codes, want):
    assert unit_code(text, codes) == want


def test_every_code_is_a_unit():
    assert all(code_unit(c) for c in (*COUNT, *MASS, *TEMP, *VOLUME, "mmHg", "kPa", "meq_per_L", "umol_per_L", "inch", "lb"))
    assert segmentations("x" * 500) == [] and segmentations("g/" * 200) == []


def test_numbers():
    first = lambda t: (readings(t)[0] or [None])[0]
    assert [first(t) for t in ("1.234,5", "1,234.5", "0,123", "38,255", "1 234,5 g", "１５１.９", "1.4e+02", "<4.2", "~5", "-3", "10⁹", "---", "n/a", "")] == [1234.5, 1234.5, 0.123, 38255.0, 1234.5, 151.9, 140.0, 4.2, 5.0, -3.0, 10.0, None, None, None]
    assert readings(">9.1 10^9/L")[1:] == (">", "10^9/L")


def table(spark, rows):
    return spark.createDataFrame(rows, "observation_id string, item string, value string, unit string, submitted_at timestamp_ntz").withColumn("unit_code", F.lit("clash")).withColumn("r", F.lit(1))


def reference(spark):
    units = [("hgb", "g_per_L", 1.0, 0.0, True, 40.0, 220.0), ("hgb", "g_per_dL", 10.0, 0.0, False, 40.0, 220.0), ("hgb", "mmol_per_L", 16.114, 0.0, False, 40.0, 220.0), ("temp", "deg_C", 1.0, 0.0, True, 32.0, 43.0), ("temp", "deg_F", 0.555556, -17.777778, False, 32.0, 43.0), ("ur", "mL", 1.0, 0.0, True, 50.0, 6000.0), ("ur", "L", 1000.0, 0.0, False, 50.0, 6000.0)]
    return spark.createDataFrame(units, "item_code string, unit_code string, factor double, shift double, is_common boolean, low_common double, high_common double"), spark.createDataFrame([("Hb", "hgb"), ("Temp.", "temp"), ("Urine", "ur")], "alias_name string, item_code string")


def test_observations(spark):
    import datetime as dt

    t = lambda k: dt.datetime(2025, 1, k)
    rows = [
        ("a", "Hb", "12.1", "g/dl", t(1)), ("b", "HB", "12,1 g/dL", "-", t(1)), ("c", "hb [g%]", "12.1", "see item", t(1)), ("d", "Hb", "121", "g/dL", t(1)), ("e", "Hb", "15.0", None, t(1)), ("f", "Hb", "15.0", "cm", t(1)), ("g", "Hb", "n/a", "g/dL", t(1)), ("h", "Temp.", "98.6 (H)", "°F", t(1)), ("i", "Urine (L)", ">1,15", "", t(1)), ("j", "Urine", "1200 (L)", "mL", t(1)),
        ("k", None, "5", "g/L", t(1)), ("l", "Hb", None, None, t(1)), ("m", "Hb", "12.1", "g/dL", t(1)), ("m", "Hb", "121", "g/L", t(2)), ("m", "Hb", "121", "g/L", t(2)), (None, "Hb", "12.1", "g/dL", None), ("n", "Hb", "9" * 3000, "g/L", t(1)), ("o", "Hb", "0.5", "g/L", t(1)),
    ]
    got = {r.observation_id: r.unit_code for r in recorded_elsewhere(table(spark, rows), *reference(spark)).collect()}
    assert got == {"a": "g_per_dL", "b": "g_per_dL", "c": "g_per_dL", "e": "g_per_dL", "h": "deg_F", "i": "L"}
    done = {r.observation_id: r for r in unify_units(table(spark, rows), *reference(spark)).collect()}
    assert len(done) == 16 and abs(done["h"].value_common - 37.0) < 0.01 and done["i"].bound == ">" and done["d"].how == "inferred" and done["f"].how == "undecided" and done["o"].how == "undecided" and done["k"].how == "unknown_item"
    assert unify_units(table(spark, rows).limit(0), *reference(spark)).count() == 0


OTHERS = ("U/L", "IU/L", "mIU/mL", "kg/m2", "mL/min", "mL/min/1.73m2", "mg/kg/day", "bpm", "mg/24h", "mg/24 h", "µkat/L", "mosm/kg", "cells per cubic mm", "m·kg/s^2", "mg/g", "J/kg", "breaths/min")


@pytest.mark.parametrize("text", OTHERS)
def test_products_and_several_factors_are_units(text):
    assert segmentations(text)


def test_no_value_is_invented_for_another_unit():
    from daywise.operators.unify_units import Item, resolve

    items = {"crea": Item((("mg_per_dL", 88.42, 0.0, 20.0, 2000.0), ("umol_per_L", 1.0, 0.0, 20.0, 2000.0)), "umol_per_L")}
    how = lambda value, unit, item="Crea": resolve(item, value, unit, {"crea": "crea"}, items)[3:]
    assert all(how("85", u) == (None, None, "undecided") for u in OTHERS + ("xyz/L", "Zorks/mL", "mg/24h"))
    assert how("1.1", "mg/24h") == (None, None, "undecided") and how("85 U/L", None) == (None, None, "undecided")
    assert all(how("85", u)[2] == "inferred" for u in (None, "", "?", "-", "see item")) and how("85 H", None)[2] == how("85 (L)", "")[2] == "inferred"
    unit, value, stated = how("1.1", "U/L", "Crea in mg/dL")
    assert (unit, round(value, 3), stated) == ("mg_per_dL", 97.262, "stated") and how("5", "mg/dL")[2] == "stated"


def test_many_readings_are_all_kept():
    assert unit_code(" ".join(["m"] * 40) + "/L", MASS) is None and unit_code("g  /  L", MASS) == "g_per_L"
    assert segmentations("g " * 300 + "/L") != []
