"""E1-E26 on their boundary values."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tremora.functions import bands, lunar, moments


def mapped(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_E1_time_text_is_parsed_without_a_zone(spark):
    assert mapped(spark, ["2024-01-31T23:59:59.123Z"], "string", moments.parse_time) == [
        dt.datetime(2024, 1, 31, 23, 59, 59, 123000)
    ]


def test_E1_other_text_is_an_error_or_null(spark):
    texts = ["2024-01-31 23:59:59", "2024-01-31T23:59:59Z", "2024-02-30T00:00:00.000Z", "", None]
    with pytest.raises(Exception, match="not a catalogue time: 2024-01-31 23:59:59"):
        mapped(spark, texts[:1], "string", moments.parse_time)
    lenient = mapped(spark, texts, "string", lambda c: moments.parse_time(c, strict=False))
    assert lenient == [None] * 5


def test_E3_E9_E11_weekdays(spark):
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 7, 23)]
    weekday = lambda c: moments.iso_weekday(c)
    assert mapped(spark, days, "timestamp_ntz", weekday) == [1, 6, 7]
    assert mapped(spark, days, "timestamp_ntz", lambda c: moments.day_name(weekday(c))) == [
        "Monday",
        "Saturday",
        "Sunday",
    ]
    assert mapped(spark, days, "timestamp_ntz", lambda c: moments.is_weekend(weekday(c))) == [
        False,
        True,
        True,
    ]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (
            bands.magnitude_category,
            {
                -1.0: "Minor", 2.999: "Minor", 3.0: "Light", 4.999: "Light", 5.0: "Moderate",
                6.0: "Strong", 7.0: "Major", 7.999: "Major", 8.0: "Great",
            },
        ),
        (
            bands.depth_category,
            {-5.0: "Shallow", 69.999: "Shallow", 70.0: "Intermediate", 299.9: "Intermediate", 300.0: "Deep"},
        ),
        (
            bands.magnitude_group,
            {3.99: "1-3", 4.0: "4", 5.0: "5", 6.0: "6-7", 7.99: "6-7", 8.0: "8-9"},
        ),
        (
            bands.marker_color,
            {2.9: "green", 3.0: "blue", 4.0: "orange", 5.0: "red", 6.0: "darkred"},
        ),
        (bands.hemisphere_ns, {0.0: "Northern", -0.01: "Southern"}),
        (bands.hemisphere_ew, {0.0: "Eastern", -0.01: "Western"}),
        (
            bands.climate_zone,
            {
                23.5: "Tropical", -23.5: "Tropical", 23.51: "Temperate", -23.51: "Temperate",
                66.5: "Temperate", -66.5: "Temperate", 66.51: "Polar", -90.0: "Polar",
            },
        ),
        (
            bands.phase_name,
            {
                0.0: "New Moon", 0.0624: "New Moon", 0.0625: "Waxing Crescent", 0.1875: "First Quarter",
                0.3125: "Waxing Gibbous", 0.4375: "Full Moon", 0.5625: "Waning Gibbous",
                0.6875: "Last Quarter", 0.8125: "Waning Crescent", 0.9374: "Waning Crescent",
                0.9375: "New Moon", 0.9999: "New Moon",
            },
        ),
        (bands.marker_radius, {1.0: 3.0, 2.0: 3.0, 4.0: 6.0}),
    ],
)
def test_classes_at_their_bounds(spark, make, cases):
    assert mapped(spark, list(cases), "double", make) == list(cases.values())


def test_E16_effect_texts_change_at_whole_magnitudes(spark):
    texts = mapped(spark, [1.9, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], "double", bands.effects_description)
    assert len(set(texts)) == 8
    assert texts[0].startswith("Micro") and texts[-1].startswith("Epic")


def test_E18_no_magnitude_falls_in_the_last_group(spark):
    assert mapped(spark, [None], "double", bands.magnitude_group) == ["8-9"]


def test_E17_energy_grows_by_1_5_decades_per_magnitude(spark):
    low, high = mapped(spark, [0.0, 1.0], "double", bands.energy_joules)
    assert math.isclose(low, 10**4.8) and math.isclose(high / low, 10**1.5)


def test_E6_region_is_what_follows_the_last_of(spark):
    places = ["10 km S of X of Y", "Fiji region", "Unknown", "Gulf of Alaska"]
    assert mapped(spark, places, "string", bands.region_of) == ["Y", "Fiji region", "Unknown", "Alaska"]


def test_E10_seasons(spark):
    assert mapped(spark, list(range(1, 13)), "int", moments.season) == (
        ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    )


def test_E24_ranks_put_unknown_names_last(spark):
    ranks = mapped(spark, ["Minor", "Great", "other", None], "string",
                   lambda c: bands.rank_in(c, bands.labels(bands.MAGNITUDE_CATEGORIES)))
    assert ranks == [1, 6, None, None]


def test_E25_E26_spans_and_texts(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 11, 59, 59))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    a, b = F.col("a"), F.col("b")
    found = rows.select(
        moments.whole_days_between(a, b),
        moments.inclusive_days(a, b),
        moments.second_text(b),
        moments.start_of_day(b),
        moments.clock_angle(F.hour(a)),
    ).first()
    assert tuple(found) == (1, 3, "2024-01-03 11:59:59", dt.datetime(2024, 1, 3), 180)


ANCHORS = {
    dt.datetime(2024, 1, 11, 11, 57): 0.0,
    dt.datetime(2024, 4, 8, 18, 21): 0.0,
    dt.datetime(2024, 1, 18, 3, 53): 0.25,
    dt.datetime(2024, 1, 25, 17, 54): 0.5,
    dt.datetime(2000, 1, 21, 4, 40): 0.5,
}


def test_E7_published_moons(spark):
    rows = spark.createDataFrame([(m, p) for m, p in ANCHORS.items()], "datetime timestamp_ntz, want double")
    for row in lunar.with_moon_phase(rows).collect():
        off = abs(row.moon_phase - row.want)
        assert min(off, 1 - off) < 0.0003
        assert 0 <= row.moon_phase < 1


def test_E7_no_time_gives_no_phase(spark):
    rows = spark.createDataFrame([(None,)], "datetime timestamp_ntz")
    assert lunar.with_moon_phase(rows).first().moon_phase is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    moment = dt.datetime(2024, 3, 10, 2, 30, 0, 5000)  # does not exist in New York
    c = F.col("datetime")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.005' AS datetime")
        found = lunar.with_moon_phase(rows).select(
            "datetime",
            moments.start_of_day(c),
            moments.epoch_micros(c),
            moments.second_text(c),
            F.hour(c),
            moments.iso_weekday(c),
            F.round("moon_phase", 9),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day = dt.datetime(2024, 3, 10)
    assert tuple(found)[:6] == (moment, day, 1710037800005000, "2024-03-10 02:30:00", 2, 7)
    assert found[6] == pytest.approx(0.983, abs=0.01)
