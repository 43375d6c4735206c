import os

import pytest

from pvtide.schema import METADATA
from pvtide.sources.csvfiles import read_metadata, read_with_rejects

HEADER = "ss_id,start_datetime_GMT,end_datetime_GMT,latitude_rounded,longitude_rounded,orientation,tilt,kWp"
GOOD = "{},2020-01-01T00:00:00Z,2024-01-01T00:30:00Z,51.5,-0.1,180.0,35.0,{}"


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")


def test_good_and_rejected_lines_are_all_lines(spark, scratch):
    put(f"{scratch}/in", "a.csv", [GOOD.format(1, 4.0), "x7,2020-01-01T00:00:00Z,,51.5,-0.1,180.0,35.0,3.0", GOOD.format(2, "")])
    put(f"{scratch}/in", "b.csv", [GOOD.format(3, "much"), "4,01/02/2020,,51.5,-0.1,180.0,35.0,3.0", "5,2020-01-01T00:00:00Z",
                                   GOOD.format(6, 1.0) + ",extra", GOOD.format(8, 2.5), "9,,,,,,,"])
    expected = [("a.csv", "does not parse: ss_id"), ("b.csv", "does not parse: kWp"), ("b.csv", "does not parse: start_datetime_GMT"),
                ("b.csv", "fields: 2 of 8"), ("b.csv", "fields: 9 of 8")]
    good, rejected = read_with_rejects(spark, f"{scratch}/in", f"{scratch}/split", METADATA)
    assert good.columns == METADATA.names and [t for _, t in good.dtypes] == [f.dataType.simpleString() for f in METADATA]
    assert sorted(r.ss_id for r in good.collect()) == [1, 2, 8, 9]
    rows = rejected.collect()
    assert sorted((r.file, r.reason) for r in rows) == expected
    assert "x7,2020-01-01T00:00:00Z,,51.5,-0.1,180.0,35.0,3.0" in {r.line for r in rows}
    assert good.count() + rejected.count() == 9
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_metadata(spark, f"{scratch}/in").collect()  # strict stays the default


def test_clean_files_have_no_rejects(spark, scratch):
    put(f"{scratch}/in", "a.csv", [GOOD.format(i, i / 2) for i in range(1, 30)])
    good, rejected = read_with_rejects(spark, f"{scratch}/in", f"{scratch}/split", METADATA, zone_less=True)
    assert rejected.count() == 0 and dict(good.dtypes)["start_datetime_GMT"] == "timestamp_ntz"
    assert sorted(good.collect()) == sorted(read_metadata(spark, f"{scratch}/in", zone_less=True).collect())
