"""Search by postings finds what a scan of the whole index finds, and reads the folders of its grams alone."""

import random
import re

import pytest

from wegloom.operators import places
from wegloom.sources import files


def test_postings_as_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["Pasar", "Kranggan", "Rumah", "Sakit", "Jl.", "Kaliurang", "Café", "Mawar", "A", "No 7", "Melati"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.choice(["place", "road"]), -7.7 - i / 1000, 110.3, rng.choice([None, "Toko Melati;Béta"]), None) for i in range(120)]
    index = places.index(spark.createDataFrame(rows, "seq bigint, name string, kind string, lat double, lon double, aliases string, address string")).cache()
    path = str(tmp_path / "p")
    places.write_postings(index, path, 8)
    for q in ("pasar", "kranggan mawar", "cafe", "jalan kaliurang", "rumah sakit a", "ka", "beta", "nowhere", "no 7 melati"):
        want = [tuple(r) for r in places.search(index, q).select("seq", "name", "total").collect()]
        assert [tuple(r) for r in places.find(spark, path, q).select("seq", "name", "total").collect()] == want, q
    with pytest.raises(ValueError):
        places.find(spark, path, "x")
    plan = places.candidates(spark, files.current(spark, path), "mawar")._jdf.queryExecution().toString()
    buckets = {int(x) for found in re.findall(r"PartitionFilters: \[.*?bucket#\d+ IN \(([\d,]+)\)", plan) for x in found.split(",")}
    assert 1 <= len(buckets) <= 3 and places.grams_of("mawar ka") == ["awa", "ka", "maw", "war"]
