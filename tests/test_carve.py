import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import carve, metadata
from evidentia.sources import sinks, tables


def bmp(n=30):
    body = b"\x07" * n
    return b"BM" + struct.pack("<IHHI", 54 + n, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 3, 1, 24, 0, n, 0, 0, 0, 0) + body


def frame(spark, *dumps):
    return spark.createDataFrame([(str(i), bytearray(d) if d is not None else None) for i, d in enumerate(dumps)], "dump_id string, content binary")


@pytest.mark.parametrize(("hexed", "want"), [("FFD800FFD811", [0, 3]), ("00FFD80011FFD8FFD9", [1, 5]), ("00112233", []), ("", [])])
def test_all_starts(spark, hexed, want):
    got = carve.offsets(frame(spark, bytes.fromhex(hexed)), carve.JPEG_START).collect()
    assert sorted(r["offset"] for r in got) == want


def test_markers_at_offsets(spark):
    df = frame(spark, bytes.fromhex("0011FFD822"))
    assert [df.select(carve.is_marker(F.col("content"), F.lit(o), carve.JPEG_START)).first()[0] for o in (2, 1, 99)] == [True, False, False]


def test_next_end(spark):
    found = carve.paired(frame(spark, bytes.fromhex("AAFFD80102FFD9BB"), bytes.fromhex("AAFFD801020304")), carve.JPEG_START, carve.JPEG_END, 2, "jpeg", 1).collect()
    assert [(r["dump_id"], r["start_offset"], r["end_offset_exclusive"]) for r in found] == [("0", 1, 7)]


def test_short_ones_leave_gaps_in_the_index(spark):
    dump = b"\xff\xd8" + b"\xff\xd9" + b"\x00" * 9 + b"\xff\xd8" + b"\x01" * 200 + b"\xff\xd9"
    assert [(r["index"], r["start_offset"], r["size"]) for r in carve.segments(frame(spark, dump), ("jpeg",)).collect()] == [(2, 13, 204)]


def test_bmp(spark):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 90, dtype=np.uint8).tobytes()
    df = frame(spark, b"\x00\x01\x02" + bmp() + b"\x99\x88", b"BM" + noise[:40] + noise + bmp(), b"BM" + bytes(5), None)
    assert sorted((r["dump_id"], r["start_offset"], r["size"]) for r in carve.segments(df, ("bmp",)).collect()) == [("0", 3, 84), ("1", 132, 84)]


def test_mixed_dump_comes_out_whole(spark):
    png = carve.PNG_START + b"abc" + carve.PNG_END
    jpeg = b"\xff\xd8" + b"q" * 150 + b"\xff\xd9"
    df = frame(spark, b"--" + png + b"--" + bmp() + b"--" + jpeg)
    got = {r["format"]: bytes(r["data"]) for r in carve.extracted(df, carve.segments(df)).collect()}
    assert got == {"png": png, "bmp": bmp(), "jpeg": jpeg}


def test_broken_exif_is_read_as_far_as_it_goes(spark):
    start = b"\xff\xd8\xff\xe1\x00\x99Exif\x00\x00"
    loop = b"II*\x00\x08\x00\x00\x00" + struct.pack("<H", 2) + struct.pack("<HHII", 0x0112, 3, 1, 99) + struct.pack("<HHII", 0x8769, 4, 1, 8) + bytes(4)
    cut = b"MM\x00*\x00\x00\x00\x08" + struct.pack(">H", 9) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0)
    rows = {r["dump_id"]: r for r in metadata.consistency(metadata.record(metadata.exif(frame(spark, start + loop, start + cut, start + b"II*", start, b"", start + b"??" + loop)))).collect()}
    assert rows["0"]["orientation"] == 99 and "orientation 99" in rows["0"]["flags"] and rows["1"]["orientation"] == 6
    assert all(not rows[k]["exif_present"] and rows[k]["flags"] == ["no EXIF"] for k in "2345")


def test_uploads(spark):
    rows = [("a.gif", b"x"), ("a.png", b""), ("a.PNG", carve.PNG_START), ("a.jpg", b"\x00\x01\x02"), ("a.jpeg", b"\xff\xd8\xff\xe0")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, content binary")
    assert [r[0] for r in df.select(carve.upload_verdict(F.col("name"), F.col("content"))).collect()] == ["bad_suffix", "empty", "ok", "bad_magic", "ok"]


def test_exif(spark):
    ascii_at = 8 + 2 + 2 * 12 + 4
    soft, when = b"Adobe Photoshop\x00", b"2020:01:01 00:00:00\x00"
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x0131, 2, len(soft), ascii_at) + struct.pack("<HHII", 0x0132, 2, len(when), ascii_at + len(soft)) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe1\x00\x99Exif\x00\x00II*\x00\x08\x00\x00\x00" + ifd + soft + when
    rows = {r["dump_id"]: r for r in metadata.consistency(metadata.record(metadata.exif(frame(spark, jpeg, b"nothing")))).collect()}
    assert rows["0"]["flags"] == ["edited with Adobe Photoshop", "no camera model"] and rows["0"]["suspicion_score"] == pytest.approx(0.4) and rows["0"]["suspicious"]
    assert rows["0"]["datetime_modified"] == "2020:01:01 00:00:00" and rows["0"]["datetime_original"] is None and not rows["0"]["gps_present"]
    assert rows["1"]["flags"] == ["no EXIF"]
    assert spark.range(1).select(metadata.degrees(F.lit("10,30,0"), F.lit("S"))).first()[0] == -10.5


def test_files_logs_and_status(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"\xff\xd8")
    assert tables.dumps(spark, str(tmp_path / "d")).first()["length"] == 2
    log = str(tmp_path / "log")
    for i in range(3):
        sinks.append_log(spark.createDataFrame([(f"2020-01-0{i + 1}", i)], "timestamp string, n int"), log)
    assert [r["n"] for r in tables.audit_log(spark, log, 2).collect()] == [2, 1]
    events = spark.createDataFrame([("a", 1, 1, "pending"), ("a", 2, 2, "completed"), ("b", 1, 1, "deleted")], "analysis_id string, ts int, seq int, status string")
    assert [(r["analysis_id"], r["status"]) for r in sinks.current_status(events).collect()] == [("a", "completed")]
    page = spark.createDataFrame([("x", bytearray(b"12"))], "name string, picture binary")
    assert "base64,MTI=" in page.select(sinks.html_rows(page, "t")).first()[0]
    odd = spark.createDataFrame([("<b>&'", None)], "`a.b` string, picture binary")
    shown = odd.select(sinks.html_rows(odd, "<t>")).first()[0]
    assert "&lt;b&gt;&amp;&#x27;" in shown and "<td>—</td>" in shown and "<title>&lt;t&gt;" in shown


def test_marker_offsets_across_ranges(spark, tmp_path):
    data = b"\xff\xff\xd8ab\xff\xd8\xff\xd8aaaa"
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    for marker in (b"\xff\xd8", b"aa"):
        want = [i for i in range(len(data)) if data.startswith(marker, i)]
        for size in (1, 2, 3, 100):
            got = tables.marker_offsets(spark, str(tmp_path), marker, size=size)
            assert sorted(r["offset"] for r in got.collect()) == want


def test_small_positions_are_plain_text(spark):
    ddl = "dump_id string, tags map<string,string>"
    tags = lambda lat, lon: {"gps": "1", "lat_ref": "S", "lat": lat, "lon_ref": "E", "lon": lon, "model": "m"}
    rows = [("a", tags("0.0,0.0,3.0", "0.0,0.0,0.04")), ("b", tags("0.0,0.0,0.0", "0.0,0.0,0.0")), ("c", tags("10.0,30.0,0.0", "0.0,0.0,36.0"))]
    got = {r["dump_id"]: r["flags"] for r in metadata.consistency(metadata.record(spark.createDataFrame(rows, ddl))).collect()}
    assert got == {"a": ["position (-0.000833, 0.000011)"], "b": ["position (-0.0, 0.0)"], "c": ["position (-10.5, 0.01)"]}
