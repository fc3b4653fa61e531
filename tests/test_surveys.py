"""Scans of corpora, mounts and accounts; documents and chunks that are written."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.sources import adm, surveys, wav

from .test_masters import AXML


def test_axml_round_trip(spark):
    parsed = adm.parse_axml(spark.createDataFrame([("p", AXML), ("q", None)], "path string, text string"))
    text = adm.write_axml(parsed)
    again = adm.parse_axml(text)
    keys = ("kind", "id", "name", "refs", "blocks")
    want = {r.id: tuple(r[k] for k in keys) for r in parsed.where("error is null").collect()}
    assert {r.id: tuple(r[k] for k in keys) for r in again.collect()} == want and len(want) == 6 and text.count() == 1


def test_chunks_of_a_description():
    rows = [(1, "ATU_00000001", "AT_00031001_01", "AP_00031001"), (2, "", "", "")]
    (a, body), (b, text) = adm.description_chunks(rows, "<x/>")
    assert (a, b, text) == ("chna", "axml", b"<x/>") and adm.parse_chna(body) == rows


def test_cut_off_files_have_what_is_there():
    x = np.arange(20).reshape(10, 2)
    whole = wav.encode(x, 48000)
    assert wav.header(io.BytesIO(whole))["frames"] == 10 and wav.header(io.BytesIO(whole[:-7]))["frames"] == 8


def test_corpus(spark, tmp_path):
    for p in ("a.atmos", "1/b.atmos", "1/2/3/c.atmos", "1/2/3/4/d.atmos", "1/e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert {r.name for r in surveys.corpus(spark, str(tmp_path)).collect()} == {"a.atmos", "b.atmos", "c.atmos"}


def test_mounts(spark):
    table = ["dev / ext4 rw", "auto /net autofs rw", "x /net/a\\040b nfs rw", "auto /both autofs", "y /both nfs", "short"]
    m = surveys.mounts(spark.createDataFrame([(t,) for t in table], "value string"))
    assert {(r.point, r.real) for r in m.collect()} == {("/", True), ("/net", False), ("/net/a b", True), ("/both", True)}
    paths = spark.createDataFrame([("/net/x",), ("/net/a b/c",), ("/network",), ("/both/z",), ("/net",)], "path string")
    assert {r.path: r.behind for r in surveys.behind_trigger(paths, m).collect()} == {"/net/x": True, "/net/a b/c": False, "/network": False, "/both/z": False, "/net": True}
    assert surveys.behind_trigger(paths, m.limit(0)).where("behind").count() == 5


def test_sources(spark):
    df = spark.createDataFrame([("l", True, None), ("l", False, None), (None, None, "o"), (None, None, None)], "l string, there boolean, o string")
    assert [r.k for r in df.select(surveys.source_kind(F.col("l"), F.col("there"), F.col("o")).alias("k")).collect()] == ["reachable", "recorded", "recorded", "unrecorded"]


def test_accounts(spark):
    text = ["element 0 4", "copy 1 2", "block 0 100 64 0", "copy 0 4", "", "w 3 1 0.5 0.25", "block 1 164 64 1", "mix 1", "g 3 0.7", "odd 1", "w 1 x 0 0"]
    got = surveys.accounts(spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, value string"), ["file"], "n").orderBy("n").collect()
    assert [(r.kind, r.block, r.error) for r in got] == [
        ("element", None, None), ("copy", None, "before any block"), ("block", 0, None), ("copy", 0, None), ("w", 0, None), ("block", 1, None), ("mix", 1, None), ("g", 1, None), ("odd", 1, "can't be read"), ("w", 1, "can't be read"),
    ]
    assert (got[2]["at"], got[2].frames, got[2].limited, got[5].limited) == (100, 64, False, True)
    assert (got[4].source, got[4].element, got[4].w_from, got[4].w_to) == (3, 1, 0.5, 0.25) and (got[7].source, got[7].w_from) == (3, 0.7)


def test_gain_samples(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# x y z L R\n0.5, 1.0, 0, 0.1, 0.9\n# more\n-1,0,0,1,0\n")
    assert [tuple(r) for r in surveys.gain_samples(spark, str(tmp_path / "a.csv"), ["L", "R"]).collect()] == [(0.5, 1.0, 0.0, 0.1, 0.9), (-1.0, 0.0, 0.0, 1.0, 0.0)]
    (tmp_path / "b.csv").write_text("1,x,0,1,0\n")
    with pytest.raises(Exception):
        surveys.gain_samples(spark, str(tmp_path / "b.csv"), ["L", "R"]).collect()


def test_grid_reads_back(spark):
    g = surveys.coordinate_grid(spark, 30).where("abs(elevation) < 90").collect()
    assert len(g) == 13 * 5 and all(abs((r.back.azimuth - r.azimuth + 180) % 360 - 180) < 1e-6 and abs(r.back.elevation - r.elevation) < 1e-6 for r in g)


def test_survey_json(spark):
    df = spark.createDataFrame([("t", [1, 2], None)], "title string, x array<int>, y string")
    assert surveys.survey_json(df, "title").collect()[0].json == '{"title":"t","x":[1,2]}'
