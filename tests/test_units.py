import math

import pytest

from tabulae.operators.units import candidates, dataset_units, expected_units, parse_unit, parse_within, page_shift, solve

TARGETS = [("USD", "USD"), ("share", "bp"), ("mass", "g"), ("energy", "kJ"), ("page", "page"), ("volume", "L")]


@pytest.mark.parametrize(
    ("text", "dimension", "size"),
    [("$000s", "USD", 1e3), ("Rs. in lakh", "INR", 1e5), ("TEUR", "EUR", 1e3), ("million kWh", "energy", 3.6e12), ("Mt CO2e", "mass", 1e15), ("ML", "volume", 1e9), ("mL", "volume", 1), ("ratio (0-1)", "share", 1e4), ("in thousands", None, 1e3), ("km²", "area", 1e10), (" hrs ", "duration", 3600)],
)
def test_parse_unit(text, dimension, size):
    got = parse_unit(text)
    assert (got.dimension, float(got.size)) == (dimension, size)


@pytest.mark.parametrize("text", [None, "", "  ", "Revenue", "see note 4", "widgets", "USD EUR"])
def test_no_unit(text):
    assert parse_unit(text) is None


def test_parse_within():
    assert parse_within("Coupon, ratio (0-1)").dimension == "share"
    assert parse_within("Net income (amounts in bn)").dimension is None
    assert parse_within("Five-year summary") is None


def best(*args):
    found = candidates(*args)
    return found and (found[0][0].dimension, float(found[0][0].size))


def test_statements_together():
    assert best("GBP", "Capex (amounts in thousands)", None, "KPIs", "money") == ("GBP", 1e3)
    assert best("GBP", "Capex", None, "KPIs (in millions)", "money") == ("GBP", 1e6)
    assert best("GBP thousand", "Capex", None, "KPIs (in millions)", "money") == ("GBP", 1e3)
    assert best("GBP", "Capex", None, "KPIs [USD million]", "money") == ("GBP", 1.0)
    assert best(None, "Capex", None, "KPIs [USD million]", "money") == ("USD", 1e6)
    assert best(None, "Capex", "€bn", "KPIs", "money") == ("EUR", 1e9)
    assert not best(None, "Sites", None, "KPIs [USD million]", None)
    assert best("kg", "Freight", None, "KPIs (in millions)", "mass") == ("mass", 1e6)


def test_identity_decides_and_flags():
    profit, revenue = parse_unit("USD million"), parse_unit("USD million")
    free = [parse_unit(u) for u in ("%", "fraction of 1", "bp")]
    columns = [
        {"key": "operating_margin", "candidates": [], "free": free, "log": math.log10(12.5)},
        {"key": "operating_profit", "candidates": [(profit, 0.0)], "log": math.log10(125)},
        {"key": "revenue", "candidates": [(revenue, 0.0)], "log": math.log10(1000)},
    ]
    assert float(solve(columns)[0][0].size) == 100
    columns[0]["log"] = math.log10(777)
    assert solve(columns)[0][0] is None
    columns[0]["log"], columns[0]["free"] = math.log10(12.5), [free[0], free[0]]
    assert solve(columns)[0][2]


def test_page_shift():
    assert page_shift([50, 51, 53], 51, 54) == (1, 0.0)
    assert page_shift([4], 4, 4) == (0, 0.0)


def test_tables(spark):
    columns = "array<struct<key:string,label:string,type:string,unit:string>>"
    schema = f"dataset_id string, table_id string, title string, page_start int, page_end int, columns {columns}, source_regions array<struct<page:int,bounding_box:array<double>>>, key string"
    rows = [
        ("d1", " T1", "KPIs", 5, 6, [("mass", "Mass", "number", "t"), ("n", "N", "number", None), ("x", "X", "number", None), (None, None, "number", None)], [(4, None), (None, None), (5, None)], "k"),
        ("d1", " T1", "KPIs", 5, 6, [("mass", "Mass", "number", "t"), ("n", "N", "number", None), ("x", "X", "number", None), (None, None, "number", None)], [(4, None), (None, None), (5, None)], "k"),
        ("d2", None, None, None, None, None, None, "k"),
    ]
    tables = spark.createDataFrame([("t1", [{"x": "12 kJ"}, {"x": "(3) kJ"}, {"x": "-"}]), ("t2", None), (None, [])], "table_id string, rows array<map<string,string>>")
    targets = spark.createDataFrame(TARGETS, "dimension string, common_unit string")
    got = {(r.rec_key, r["item"]): (r.common_unit, r.common_number, r.factor) for r in dataset_units(spark.createDataFrame(rows, schema), tables, targets).collect()}
    assert got == {("d1", "mass"): ("g", 10**6, 1e6), ("d1", "x"): ("kJ", 1, 1.0), ("d1", "region_0"): ("page", 5, 1.0), ("d1", "region_2"): ("page", 6, 1.0)}
    assert dataset_units(spark.createDataFrame([], schema), tables, targets).count() == 0
    refs = spark.createDataFrame([(1, ["$m", None, " ", "bp", "odd"]), (1, ["$m", None, " ", "bp", "odd"]), (2, None)], "ref_id bigint, expected_units array<string>")
    assert sorted((r.rec_key, r["item"], r.common_unit, r.common_number) for r in expected_units(refs, targets).collect()) == [("1", "0", "USD", 10**6), ("1", "3", "bp", 1)]


@pytest.mark.parametrize(
    ("text", "dimension", "size"),
    [("kg/m³", "density", 1), ("g / cm3", "density", 1e3), ("kilograms per cubic metre", "density", 1), ("mg/L", "density", 1e-3), ("kW", "power", 1e3), ("megawatts", "power", 1e6), ("million kW", "power", 1e9), ("kWh", "energy", 3.6e6)],
)
def test_density_and_power(text, dimension, size):
    got = parse_unit(text)
    assert (got.dimension, float(got.size)) == (dimension, size)


@pytest.mark.parametrize("text", ["kg/h", "USD/m3", "m3/kg", "kg/", "per m3", "g/m3/L"])
def test_other_ratios_are_no_units(text):
    assert parse_unit(text) is None


def test_mass_and_energy_decided_by_identity(spark):
    columns = "array<struct<key:string,label:string,type:string,unit:string>>"
    schema = f"dataset_id string, table_id string, title string, page_start int, page_end int, columns {columns}, source_regions array<struct<page:int,bounding_box:array<double>>>"
    number = lambda key, unit=None: (key, key, "number", unit)
    rows = [
        ("d1", "t1", "Stock", None, None, [number("mass"), number("density", "kg/m3"), number("volume", "m3")], None),
        ("d2", "t2", "Plants", None, None, [number("energy"), number("power", "kW"), number("duration", "h")], None),
        ("d3", "t3", "Stock", None, None, [number("mass"), number("density", "kg/m3"), number("volume", "m3")], None),
        ("d4", "t4", "Stock", None, None, [number("mass"), number("density"), number("volume", "m3")], None),
    ]
    cells = [("t1", [{"mass": "15.7", "density": "7850", "volume": "2"}]), ("t2", [{"energy": "12", "power": "500", "duration": "24"}]), ("t3", [{"mass": "5.1", "density": "7850", "volume": "2"}]), ("t4", [{"mass": "15.7", "density": "7.85", "volume": "2"}])]
    tables = spark.createDataFrame(cells, "table_id string, rows array<map<string,string>>")
    targets = spark.createDataFrame(TARGETS, "dimension string, common_unit string")
    found = {(r.rec_key, r["item"]): r for r in dataset_units(spark.createDataFrame(rows, schema), tables, targets).collect()}
    assert {k: (r.common_unit, r.factor) for k, r in found.items() if k[1] in ("mass", "energy") and not r.non_unique} == {("d1", "mass"): ("g", 1e6), ("d2", "energy"): ("kJ", 3.6e6)}
    assert found["d4", "mass"].non_unique and ("d3", "mass") not in found


def column(key, values, unit=None, free=()):
    return {"key": key, "candidates": [(parse_unit(unit), 0.0)] if unit else [], "free": [parse_unit(u) for u in free], "log": math.log10(values)}


MASSES, DENSITIES, VOLUMES = ("g", "kg", "t", "kt"), ("kg/m3", "g/cm3", "mg/L"), ("L", "m3", "ML")


def test_two_identities_decide_together():
    # the volume alone fits two units with the first mass; only one of them fits the second mass as well
    found = solve([column("steel_mass", 15700, "kg"), column("steel_density", 7850, "kg/m3"), column("volume", 2, free=VOLUMES), column("oil_mass", 1.6, free=MASSES), column("oil_density", 800, "kg/m3")])
    assert [float(r.size) for r, _, _ in found] == [1e6, 1.0, 1e6, 1e9, 1.0] and not any(u for _, _, u in found)


def test_contradictions_leave_columns_unread():
    found = solve([column("steel_mass", 15700, "kg"), column("steel_density", 7850, "kg/m3"), column("volume", 3.1, free=VOLUMES)])
    assert found[2][0] is None and found[0][0] and not found[0][2]


def test_ties_over_whole_combinations_are_flagged():
    found = solve([column("mass", 15.7, free=MASSES), column("density", 7.85, free=DENSITIES), column("volume", 2, "m3")])
    assert found[0][2] and found[1][2] and not found[2][2]


def test_columns_of_other_things_are_not_bound():
    found = solve([column("steel_mass", 15.7, free=MASSES), column("oil_density", 7850, "kg/m3"), column("steel_volume", 2, "m3")])
    assert found[0][0] is None


def test_margins_of_any_kind_by_their_words():
    found = solve([column("net_margin", 0.125, free=("%", "fraction of 1", "bp")), column("net_profit", 125, "USD million"), column("revenue", 1, "USD bn"), column("gross_profit", 400, "USD million")])
    assert float(found[0][0].size) == 1e4
    mixed = solve([column("net_margin", 0.125, free=("%",)), column("net_profit", 125, "USD"), column("revenue", 1, "EUR")])
    assert mixed[0][0] is None
