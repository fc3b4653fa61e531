"""Sources of masters: CAF, floats in WAVE, update streams, ADM documents."""

import struct

import numpy as np
import pytest

from auralake.sources import adm, caf, masters, matroska, wav

STREAM = """sampleRate: 48000
events:
  - ID: 10
    samplePos: 0
    active: true
    pos: [-1, 0.5, 0]
    gain: -inf
    binauralRenderMode: off
  - ID: 11
    samplePos: 512
    zones: no back
"""
AXML = """<ebuCore xmlns="urn:x"><format><audioFormatExtended>
<audioChannelFormat audioChannelFormatID="AC_00031001" audioChannelFormatName="o"><audioBlockFormat audioBlockFormatID="AB_1" rtime="00:00:00.0">
<cartesian>1</cartesian><position coordinate="X">-1.0</position><position coordinate="Y">1.0</position><gain>0.5</gain><jumpPosition interpolationLength="0.1">1</jumpPosition><odd/></audioBlockFormat></audioChannelFormat>
<audioStreamFormat audioStreamFormatID="AS_1"><audioChannelFormatIDRef>AC_00031001</audioChannelFormatIDRef></audioStreamFormat>
<audioTrackFormat audioTrackFormatID="AT_1"><audioStreamFormatIDRef>AS_1</audioStreamFormatIDRef></audioTrackFormat>
<audioTrackUID UID="ATU_1"><audioTrackFormatIDRef>AT_1</audioTrackFormatIDRef></audioTrackUID>
<audioTrackUID UID="ATU_2"><audioChannelFormatIDRef>AC_9</audioChannelFormatIDRef></audioTrackUID>
<audioTrackUID UID="ATU_3"/></audioFormatExtended></format></ebuCore>"""


@pytest.mark.parametrize("flags, open_ended", [(0, False), (2, True)])
def test_caf(spark, tmp_path, flags, open_ended):
    x = np.random.default_rng(4).integers(-(1 << 31), 1 << 31, (250, 2))
    raw = x.astype("<i4" if flags & 2 else ">i4").tobytes()
    (tmp_path / "a.caf").write_bytes(caf.encode(raw, 48000.0, 2, 32, flags, open_ended))
    spark.dataSource.register(caf.CafSource)
    got = np.zeros_like(x)
    for r in spark.read.format("pcm_caf").option("blockSize", 100).load(str(tmp_path)).collect():
        got[r.start : r.start + len(r.samples), r.channel] = r.samples
    assert (got == x).all()


def test_24_bits_big_endian_and_floats():
    assert wav.decode(b"\xff\xff\xfe\x00\x00\x01", 24, "i", ">").tolist() == [-2, 1]
    assert wav.decode(struct.pack("<4f", 1.0, -1.0, 0.5, 0.0), 32, "f").tolist() == [8388607, -8388608, 4194304, 0]


def test_updates(spark, tmp_path):
    (tmp_path / "a.metadata").write_text(STREAM)
    (tmp_path / "b.metadata").write_text(STREAM + "    colour: red\n")
    (tmp_path / "c.metadata").write_text("")
    spark.dataSource.register(masters.EventSource)
    df = spark.read.format("master_events").load(str(tmp_path))
    rows = df.orderBy("file", "ix").collect()
    a = [r for r in rows if r.file == "a.metadata"]
    assert [(r.sample_rate, r.ID, r.samplePos, r.active, r.pos, r.gain, r.zones, r.binauralRenderMode) for r in a] == [
        (48000, 10, 0, True, [-1.0, 0.5, 0.0], float("-inf"), None, "off"),
        (48000, 11, 512, None, None, None, "no back", None),
    ]
    assert [r.error for r in rows if r.file == "b.metadata" and r.error] == ["line 12: 'colour'"]
    text = masters.event_text(df.where("file = 'a.metadata'")).orderBy("ix").collect()
    assert "sampleRate: 48000\nevents:\n" + "".join(r.text + "\n" for r in text) == STREAM
    assert list(masters.events(iter(STREAM.splitlines())))[1][1] == 1


def test_components(spark):
    d = spark.createDataFrame([("s", "m", ".audio", "old.audio"), ("s", "m", ".metadata", "m.metadata"), ("t", "m", ".audio", None)], "set string, stem string, suffix string, referenced string")
    f = spark.createDataFrame([("s", "m.audio"), ("s", "m.metadata"), ("s", "m.metadata")], "set string, name string")
    got = sorted((r.set, r.suffix, r.path, r.match) for r in masters.resolve(d, f).collect())
    assert got == [("s", ".audio", "m.audio", "by_convention"), ("s", ".metadata", "m.metadata", "exact"), ("t", ".audio", None, "missing")]


def test_adm(spark):
    df = spark.createDataFrame([("a", AXML), ("b", "<x/>"), ("c", None)], "path string, text string")
    e = adm.parse_axml(df).cache()
    rows = {(r.path, r.id): r for r in e.collect()}
    b = rows["a", "AC_00031001"].blocks[0]
    assert (b.cartesian, b.position, b.gain, b.jump, b.interpolation, b.width) == (True, [-1.0, 1.0, 0.0], 0.5, True, "0.1", None)
    assert rows["a", "AC_00031001"].ignored == {"odd": 1}
    assert rows["b", None].error == "no audioFormatExtended" and rows["c", None].error == "no document"
    got = {r.uid: r.channel_format for r in adm.channel_of_track(e).collect()}
    assert got == {"ATU_1": "AC_00031001", "ATU_2": "AC_9", "ATU_3": None}


def test_bw64_description(tmp_path):
    row = struct.pack("<H12s14s11sx", 1, b"ATU_00000001", b"AT_00031001_01", b"AP_00031001")
    chna = struct.pack("<HH", 1, 1) + row
    body = wav.encode(np.zeros((4, 1), dtype=np.int64), 48000)
    axml = AXML.encode()

    def chunk(name, data):
        return struct.pack("<4sI", name, len(data)) + data + bytes(len(data) % 2)

    (tmp_path / "a.wav").write_bytes(body + chunk(b"chna", chna) + chunk(b"axml", axml))
    tracks, text = adm.description(str(tmp_path / "a.wav"))
    assert tracks == [(1, "ATU_00000001", "AT_00031001_01", "AP_00031001")] and text == AXML
    (tmp_path / "b.wav").write_bytes(body)
    assert adm.description(str(tmp_path / "b.wav")) is None
    (tmp_path / "c.wav").write_bytes(body + chunk(b"chna", chna))
    with pytest.raises(ValueError):
        adm.description(str(tmp_path / "c.wav"))
    with pytest.raises(ValueError):
        adm.parse_chna(chna[:30])


@pytest.mark.parametrize("open_ended", [False, True])
def test_matroska(spark, tmp_path, open_ended):
    frames = [(t * 400, bytes([t % 256]) * (t * 7 % 300)) for t in range(100)]
    (tmp_path / "a.mka").write_bytes(matroska.encode(frames, "A_FLAC", open_ended=open_ended))
    spark.dataSource.register(matroska.MatroskaSource)
    df = spark.read.format("matroska_blocks").option("clustersPerPartition", 3).load(str(tmp_path))
    rows = df.orderBy("ticks").collect()
    assert [(r.ticks, bytes(r.payload)) for r in rows] == frames and all(r.track == 1 and r.key for r in rows)
    assert df.rdd.getNumPartitions() == 3
    (tmp_path / "b.mka").write_bytes(b"RIFF")
    with open(tmp_path / "b.mka", "rb") as f, pytest.raises(ValueError):
        matroska.clusters(f, 4)
