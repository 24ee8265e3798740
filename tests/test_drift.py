import json

from sparkloom.operators import drift

SCHEMA = "file_id long, series_id long, data_year int, line_no int, record string, k string, field string"


def frame(spark, files):
    out = []
    for file_id, series, year, records in files:
        for i, r in enumerate(records):
            out.append((file_id, series, year, i, r if r is None or isinstance(r, str) else json.dumps(r), "clash", "clash"))
    return spark.createDataFrame(out, SCHEMA)


def building(i, year, **names):
    gas, name, place = names.get("gas", "Gas"), names.get("name", "Name"), names.get("place", "Place")
    return {"OSEBuildingID": i, name: f"House {i}", gas: round((i * 37 % 90 + 5) * (1 + (year % 7) / 100), 2), place: {"lat": 46 + i / 100, "city": f"Town {i % 3}"}}


def test_changes(spark):
    a = [building(i, 2015) for i in range(1, 30)]
    b = [building(i, 2016, gas="GasUse(kBtu)") | {"Extra": 1} for i in range(3, 33)]
    c = [{k: v for k, v in building(i, 2018, gas="GasUse(kBtu)").items() if k != "Place"} | {"Extra": None, "City": f"Town {i % 3}", "Lat": 46 + i / 100} for i in range(3, 33)]
    c = [r | {"GasUse(kBtu)": str(r["GasUse(kBtu)"])} for r in c]
    files = frame(spark, [(1, 1, 2015, a + ['{"OSEBuil', None, "[1]"] + a[:2]), (2, 1, 2016, b), (3, 1, 2018, c)])
    got = {(r.file_id, r.change, r.old_field, r.new_field) for r in drift.schema_changes(files).collect()}
    assert got == {
        (2, "renamed", "Gas", "GasUse(kBtu)"),
        (2, "added", "", "Extra"),
        (3, "removed", "Place", ""),
        (3, "added", "", "City"),
        (3, "added", "", "Lat"),
        (3, "retyped", "GasUse(kBtu)", "GasUse(kBtu)"),
    }


def test_returning_field_is_added_and_other_series_do_not_mix(spark):
    with_it = [building(i, 2015) for i in range(20)]
    without = [{k: v for k, v in r.items() if k != "Name"} for r in with_it]
    files = frame(spark, [(1, 1, 2015, with_it), (2, 1, 2016, without), (3, 1, 2017, with_it), (9, 2, 2016, without)])
    got = {(r.file_id, r.change, r.old_field, r.new_field) for r in drift.schema_changes(files).collect()}
    assert got == {(2, "removed", "Name", ""), (3, "added", "", "Name")}


def test_empty_and_null(spark):
    assert drift.schema_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drift.schema_changes(frame(spark, [(None, 1, 2015, [{"a": 1}]), (1, None, 2015, [{"a": 1}]), (1, 1, 2015, ["bad", None])])).count() == 0


def test_sketch_is_bounded_and_coordinated(spark):
    a, b = [building(i, 2015) for i in range(3000)], [building(i, 2016, gas="Gas Use") for i in range(3000)]
    files = frame(spark, [(1, 1, 2015, a), (2, 1, 2016, b)])
    sizes = [len(r.sketch) for r in drift.profile_fields(files, "OSEBuildingID", 100).collect() if r.sketch]
    assert max(sizes) < 200
    assert {r.change for r in drift.schema_changes(files, sketch=100).collect()} == {"renamed"}


def test_unify(spark):
    files = frame(spark, [(1, 1, 2015, [building(i, 2015) for i in range(20)]), (2, 1, 2016, [building(i, 2016, gas="Gas Use") for i in range(20)] + ["{bad"])])
    names = drift.canonical_names(drift.schema_changes(files), drift.profile_fields(files, "OSEBuildingID"))
    assert names["Gas"] == names["Gas Use"]
    table = drift.unify(files, names)
    assert table.count() == 40
    assert table.filter(f"`{names['Gas']}` is null").count() == 0
    assert [r.record for r in drift.rejects(files).collect()] == ["{bad"]
    kinds = drift.field_kinds(files)
    types = drift.column_types(kinds, names)
    assert types[names["Gas"]] == "double" and types["Name"] == "string"
    typed = drift.unify(files, names, types)
    assert dict(typed.dtypes)[names["Gas"]] == "double" and typed.filter(f"`{names['Gas']}` > 0").count() == 40


def test_matching_is_maximal():
    assert drift.best_matching([[0.9, 0.8], [0.85, 0.1]]) == [1, 0]
    assert drift.best_matching([[0.0, 0.0]]) == [-1]
    assert drift.best_matching([]) == []
    assert drift.best_matching([[0.5], [0.9], [0.0]]) == [-1, 0, -1]


def test_names_and_numbers():
    assert drift.name_similarity("GHGEmissions(MetricTonsCO2e)", "ghgemissions") == 1.0
    assert drift.name_similarity("Comment", "Outlier") < 0.6
    assert drift.number_in("1.23 t CO2e") == 1.23
    assert drift.number_in('{"value": 5, "unit": "t"}') == 5
    assert drift.number_in("12 High Street 4") is None


def test_rare_field_keeps_its_values(spark):
    def lines(rare):
        return [{"OSEBuildingID": i, "Name": f"House {i}"} | ({rare: round(7.3 + i * 1.7, 2)} if i % 100 == 0 else {}) for i in range(1, 2001)]

    files = frame(spark, [(1, 1, 2015, lines("Steam")), (2, 1, 2016, lines("Qvxz"))])
    kept = {(r.file_id, r.field): len(r.sketch) for r in drift.profile_fields(files, "OSEBuildingID", 64).collect()}
    assert kept[1, "Steam"] == kept[2, "Qvxz"] == 20 and kept[1, "Name"] == 64
    assert {(r.change, r.old_field, r.new_field) for r in drift.schema_changes(files, sketch=64).collect()} == {("renamed", "Steam", "Qvxz")}
