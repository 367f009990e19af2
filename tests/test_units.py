import pytest

from aerolith.functions.unitgrammar import CANONICAL, convert, read_note, read_quantity, units_in
from aerolith.operators.units import other_units, resolve_units


@pytest.mark.parametrize(
    "text, want",
    [
        ("Unités : GLO (joules par cm2) / PSTAT (hectopascals)", {"GLO": 1.0, "PSTAT": 1.0}), ("ray. global : W/m²\nN in /8", {"GLO": 0.36, "N": 1.0}), ("Globalstrahlung=mégajoules par m2; Luftdruck (mbar)", {"GLO": 100.0, "PSTAT": 1.0}),
        ("P in in. Hg", {"PSTAT": 33.86389}), ("pression : Torr", {"PSTAT": 1.33322368}), ("plus de relevé en mmHg depuis la révision", {}), ("étalonnage W/m2 prévu en fin d'année", {}), ("attention nebulosite=pour cent ce relevé", {"N": 0.08}),
        ("W/m² pour rayt IR", {"INFRAR": 0.36}), ("N en part du ciel (0 à 1)", {"N": 8.0}), ("Bedeckung in Zehntel", {"N": 0.8}), ("longwave down : kJ.m-2", {"INFRAR": 0.1}), ("GLO en Wh/m²", {"GLO": 0.36}), (None, {}), ("", {}),
    ],
)
def test_notes(text, want):
    assert read_note(text) == pytest.approx(want)


def test_offsets():
    f, c, k = (units_in(u)[0] for u in ("°F", "°C", "kelvin"))
    assert convert(212.0, f, c) == pytest.approx(100) and convert(-40.0, f, c) == pytest.approx(-40) and convert(0.0, c, k) == pytest.approx(273.15)
    assert convert(300.0, k, f) == pytest.approx(80.33) and convert(1.0, units_in("hPa")[0], c) is None
    assert convert(9.0, units_in("°F/h")[0], units_in("°C/h")[0]) == pytest.approx(5) and convert(1013.25, units_in("hPa")[0], units_in("atm")[0]) == pytest.approx(1)


def test_dimensions():
    assert units_in("J cm^-2")[0].to(CANONICAL["GLO"]) == pytest.approx(1)
    assert units_in("W m^-2")[0].to(CANONICAL["GLO"]) == pytest.approx(0.36)
    assert units_in("hPa")[0].to(CANONICAL["GLO"]) is None
    value, unit = read_quantity("1 013,2 hPa")
    assert value == 1013.2 and unit.to(CANONICAL["PSTAT"]) == pytest.approx(1)


R = "obs_id bigint, station_id bigint, minute bigint, arrived bigint, ALTI double, PSTAT double, INFRAR double, GLO double, DIR double, DIF double, N double, remark string"
FD = "feed_id bigint, station_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, note string"


def test_rows(spark):
    feeds = spark.sql("SELECT 1L feed_id, 5L station_id, TIMESTAMP_NTZ '1970-01-01 00:00:00' valid_from, CAST(NULL AS TIMESTAMP_NTZ) valid_to, 'pression : hPa, N : octas' note")
    data = [
        (1, 5, 60, 60, 50.0, 101000.0, 110.0, 100.0, 50.0, 52.0, 9.0, None), (2, 5, 120, 60, 50.0, 757.0, 305.0, 277.0, 50.0, 52.0, 0.5, None), (3, 5, None, 60, None, 1010.0, -999.0, 0.0, None, None, 10.0, "N en dixièmes"),
        (4, 5, 180, 60, 50.0, None, float("nan"), None, None, None, None, None), (5, None, 180, 60, 50.0, 29.9, 0.0, 5.0, None, None, 255.0, None),
    ]
    out = resolve_units(spark.createDataFrame(data, R), feeds)
    r = {x.obs_id: x for x in out.collect()}
    assert r[1].PSTAT_value == pytest.approx(1010) and r[1].N_missing and r[1].GLO_factor == 1
    assert r[2].PSTAT_value == pytest.approx(1009.25, abs=0.1) and r[2].INFRAR_factor == 0.36 and r[2].GLO_factor == 0.36 and r[2].N_value == 4
    assert r[3].N_value == pytest.approx(8) and r[3].INFRAR_missing and r[3].PSTAT_factor == 1
    assert r[4].INFRAR_missing and r[4].N_missing and r[4].GLO_missing and r[4].PSTAT_missing
    assert r[5].N_missing and r[5].INFRAR_missing and r[5].PSTAT_value == pytest.approx(1012.5, abs=0.2)
    other = {(x.obs_id, x.field) for x in other_units(out).collect()}
    assert {(1, "PSTAT"), (2, "PSTAT"), (2, "INFRAR"), (2, "GLO"), (2, "N"), (3, "N"), (5, "PSTAT")} == other


def test_empty(spark):
    assert resolve_units(spark.createDataFrame([], R), spark.createDataFrame([], FD)).count() == 0
