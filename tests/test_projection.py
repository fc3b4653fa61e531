"""Sets, projections and what they lose."""

import pytest
from pyspark.sql import functions as F

from auralake.operators import projection as J
from auralake.operators import report as R
from auralake.sources import sets

CONFIG = """language: en
version: 0.5.1
presentations:
  - type: home
    simplified: false
    metadata: other.atmos.metadata
    audio: a.atmos.audio
    offset: 0.0
    scBedConfiguration: [0, 3]
    creationTool: "a tool"
    bedInstances:
      - channels:
          - channel: L
            ID: 0
          - channel: LFE
            ID: 3
    objects:
      - description: one
        ID: 10
      - ID: 11
"""


def test_config_round_trip(spark):
    df = spark.createDataFrame([("p", CONFIG), ("bad", CONFIG + "odd: 1\n"), ("none", None), ("twice", "version: 1\nversion: 2\n")], "path string, text string")
    c = sets.configs(df)
    got = {r.path: r for r in c.collect()}
    assert got["p"].error is None and all(got[k].error for k in ("bad", "none", "twice"))
    p = got["p"].presentations[0]
    assert [b.channel for b in p.beds] == ["L", "LFE"] and [o.id for o in p.objects] == [10, 11] and p.sc_bed == [0, 3] and p.creationTool == "a tool"
    again = sets.configs(sets.config_text(sets.presentations(c)))
    assert again.collect()[0] == got["p"]


def test_sets_are_opened(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.atmos").write_text(CONFIG)
    (tmp_path / "deep" / "a.atmos.metadata").write_text("x")
    r, = sets.open_sets(spark, str(tmp_path)).collect()
    assert (r.metadata_match, r.metadata_path, r.audio_match) == ("by_convention", "a.atmos.metadata", "missing")
    opened = sets.open_sets(spark, str(tmp_path))
    events = spark.createDataFrame([("a.atmos.metadata", 1), ("b", 2)], "file string, samplePos long")
    assert [(x.stem, x.samplePos) for x in sets.read_events(opened, events, 0).collect()] == [("a", 1)]
    assert sets.read_events(opened.withColumn("metadata_path", F.lit(None).cast("string")), events, 0).collect()[0].error == "missing: other.atmos.metadata"


def test_mono_sets(spark):
    rows = [("s_0.wav", 1, 48000, 24, 9, False), ("s_1.wav", 1, 48000, 24, 9, False), ("t_0.wav", 1, 48000, 24, 9, False), ("t_2.wav", 1, 48000, 24, 9, False), ("u_0.wav", 1, 48000, 24, 9, False), ("u_1.wav", 1, 44100, 24, 9, False), ("v_0.wav", 2, 1, 1, 1, False), ("no.wav", 1, 1, 1, 1, False)]
    got = {r.prefix: (r.channels, r.error) for r in sets.mono_sets(spark.createDataFrame(rows, "path string, channels int, rate int, depth int, frames long, is_float boolean")).collect()}
    assert got == {"s": (2, None), "t": (2, "a file is missing"), "u": (2, "rates differ"), "v": (1, "more channels than one")}


def test_output_is_no_input():
    assert sets.same_place("/a/b/../c", ["/a/c"]) and sets.same_place("/a", ["/a/x/y"]) and not sets.same_place("/a/b", ["/a/bc"])


def scene(spark):
    beds = spark.createDataFrame([("s", 0, 0, "L"), ("s", 1, 3, "LFE"), ("s", 2, 77, "Odd")], "set string, ix int, id long, channel string")
    objects = spark.createDataFrame([("s", 0, 10), ("s", 1, 11)], "set string, ix int, id long")
    updates = spark.createDataFrame([
        ("s", 10, 0, [0.5, -1.0, 0.0], -6.0, None, 0, 44100), ("s", 10, 1000, None, None, False, None, 44100), ("s", 10, 3000, [1.0, 1.0, 1.0], None, True, 512, 44100), ("x", 10, 5, None, None, None, None, 1),
    ], "set string, id long, at long, pos array<double>, gain double, active boolean, rampLength long, sample_rate long")
    audio = spark.createDataFrame([("s", 5, 9000, 48000), ("x", 5, 1, 48000)], "set string, channels int, frames long, rate int")
    return beds, objects, updates, audio


def test_round_trip(spark):
    made = J.to_adm(*scene(spark), ["at"])
    b = made["object_blocks"].orderBy("track", "ix").collect()
    assert [(r.track, r.start, r.until, round(r.gain, 6), r.ramp) for r in b] == [(4, 0, 1000, 0.501187, 0), (4, 1000, 3000, 0.0, 0), (4, 3000, 9000, 0.501187, 512), (5, 0, 9000, 0.0, None)]
    assert [r.position for r in b] == [[0.5, -1.0, 0.0], [0.5, -1.0, 0.0], [1.0, 1.0, 1.0], None]
    assert {(r.label, r.azimuth) for r in made["bed_blocks"].collect()} == {("M+030", 30.0), ("LFE1", 0.0), ("Odd", None)}
    assert [r.error for r in made["errors"].collect()] == ["0 elements declared, 5 channels of audio"]
    assert made["notes"].count() == 3
    tracks = made["elements"].join(made["bed_blocks"].select("set", "track", "label"), ["set", "track"], "left")
    tracks = tracks.select("set", "track", F.when(F.col("bed"), "DirectSpeakers").otherwise("Objects").alias("kind"), "label", F.lit(1).alias("entries"))
    back = J.to_master(tracks, made["object_blocks"])
    assert [(r.id, r.channel) for r in back["beds"].orderBy("ix").collect()] == [(0, "L"), (3, "LFE"), (2, "Odd")]
    events = back["events"].where("id >= 10").orderBy("seq").collect()
    assert [(e.id, e["at"], e.pos) for e in events] == [(10, 0, [0.5, -1.0, 0.0]), (11, 0, None), (10, 1000, [0.5, -1.0, 0.0]), (10, 3000, [1.0, 1.0, 1.0])]
    assert [round(e.gain, 6) for e in events if e.gain > -100] == [-6.0, -6.0]
    faulty = tracks.withColumn("entries", F.when(F.col("track") == 1, 2).otherwise(1))
    assert J.to_master(faulty, made["object_blocks"])["errors"].count() == 1 and J.to_master(faulty, made["object_blocks"])["events"].count() == 0


def test_polar_blocks_become_places(spark):
    df = spark.createDataFrame([(1, 0, [30.0, 0.0, 1.0], False, 4.0, 5), (1, 9, None, True, None, None)], "o int, start long, position array<double>, cartesian boolean, width double, importance int")
    df = df.withColumns({"gain": F.lit(None).cast("double"), "ramp": F.lit(None).cast("long"), "zones": F.lit(None).cast("string"), "snap": F.lit(None).cast("boolean"), "elevation": F.lit(None).cast("boolean"), "screen_factor": F.lit(0.0), "depth_factor": F.lit(0.0)})
    k, = J.keyframes(df, ["o"]).collect()
    assert [round(v, 9) for v in k.position] == [-1.0, 1.0, 0.0] and (k.gain, k.spread, k.importance, k.mode.screen) == (1.0, 1.0, 0.5, None)


def test_snr_of_silence(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 10.0, 1.0)], "k string, s double, e double")
    assert {r.k: r.snr for r in R.snr(df, ["k"], F.col("s"), F.col("e")).collect()} == {"a": float("inf"), "b": float("-inf"), "c": 20.0}


def test_unmatched_rows_have_no_place(spark):
    sheet, key = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("z", 9.0)], "file string, score double"), spark.createDataFrame([("a", "x"), ("b", "x")], "file string, condition string")
    assert {r.file: r.place for r in R.ranked(sheet, key, "file", ["condition"], "score", ["file"]).collect()} == {"a": 2, "b": 1, "z": 0}


@pytest.mark.parametrize("a, b, want", [(b"abc", b"abc", None), (b"abc", b"abd", 2), (b"abc", b"ab", 2), (b"", b"x", 0)])
def test_first_difference(spark, a, b, want):
    df = [spark.createDataFrame([("f", 0, bytearray(x))], "f string, block int, data binary") for x in (a, b)]
    assert R.first_difference(*df, ["f"], "block", "data", 100).collect()[0].offset == want
