import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ocuspark.operators import pixels
from ocuspark.sources import tables


def png(path, pixels_rgb, w, h):
    """A minimal 8-bit RGB PNG."""
    raw = b"".join(b"\0" + bytes(v for x in range(w) for v in pixels_rgb[y][x]) for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    data += chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    path.write_bytes(data)
    return data


def test_images_become_pixels(spark, tmp_path):
    img = [[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(10, 20, 30), (0, 0, 0), (255, 255, 255)]]
    png(tmp_path / "a.png", img, 3, 2)
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("skip")
    images = tables.read_images(spark, str(tmp_path))
    assert images.count() == 1
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in tables.image_pixels(images).collect()}
    assert got == {(y, x): img[y][x] for y in range(2) for x in range(3)}
    vec = pixels.visual_vector(tables.image_pixels(images)).first()
    assert 0 <= vec.layout_symmetry <= 1 and vec.shannon_entropy > 2


def test_content_identity(spark, tmp_path):
    img = [[(1, 2, 3)]]
    data = png(tmp_path / "a.png", img, 1, 1)
    png(tmp_path / "b.png", img, 1, 1)
    rows = tables.file_identity(spark, str(tmp_path)).collect()
    assert {r.sha256 for r in rows} == {hashlib.sha256(data).hexdigest()} and len(rows) == 2


def test_gaze_csv_round_trip(spark, scratch):
    rows = [(1, 1, 5, 0.5, None, 0.25, 0.75, 1, 1)]
    df = spark.createDataFrame(rows, tables.GAZE_SCHEMA)
    tables.write_gaze(df, f"{scratch}/g")
    assert "NaN" in "".join(r.value for r in spark.read.text(f"{scratch}/g").collect())
    assert tables.read_gaze(spark, f"{scratch}/g").collect() == df.collect()


def test_trials_with_bad_numbers(spark, tmp_path):
    head = "participant,image_name,cognitive_load,highlight,total_num_fixations,mean_fixation_duration,fixation_frequency,total_fixation_duration,aoi_hit\n"
    (tmp_path / "t.csv").write_text(head + "1,img,Absent,Static,oops,-99.99,3.5,10,1\n")
    from ocuspark.operators.study import clean_trials

    r = clean_trials(tables.read_trials(spark, str(tmp_path / "t.csv"))).first()
    assert (r.total_num_fixations, r.mean_fixation_duration, r.fixation_frequency) == (None, None, 3.5)


def test_log_and_manifest(spark, tmp_path):
    (tmp_path / "x.log").write_text("a,b,c\n d,e \n")
    rows = tables.read_log(spark, str(tmp_path / "x.log"), 3).collect()
    assert [tuple(r) for r in rows] == [("a", "b", "c"), ("d", "e", None)]
    (tmp_path / "m.csv").write_text("Image Name;Category\n a.png ; Web \n;web\nb.png;POSTER\n")
    rows = tables.read_manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [tuple(r) for r in rows] == [("a.png", "web"), ("b.png", "poster")]


def test_sinks(spark, scratch):
    df = spark.createDataFrame([("a", "web", 1.0), ("b", "mobile", 2.0)], "name string, category string, f double")
    tables.write_features(df, f"{scratch}/f")
    tables.write_features(df.limit(1), f"{scratch}/f")
    assert spark.read.parquet(f"{scratch}/f").count() == 3
    tables.write_report(df, f"{scratch}/r")
    assert spark.read.option("header", True).csv(f"{scratch}/r").columns == df.columns
    tables.write_lookup(df, f"{scratch}/l")
    assert tables.read_lookup(spark, f"{scratch}/l").count() == 2


def test_features_are_appended_once(spark, scratch):
    """Reruns, overlaps, an empty batch and one that failed before its commit."""
    schema = "name string, f double, category string"
    rows = lambda *names: spark.createDataFrame([(n, float(len(n or "")), "web") for n in names], schema)
    stored = lambda: sorted((r.name or "-", r.batch) for r in tables.read_features(spark, f"{scratch}/f", rows("x").schema).collect())
    assert stored() == []
    tables.append_features(rows(), f"{scratch}/f", "none", "name")
    tables.append_features(rows("a", "bb"), f"{scratch}/f", "01", "name")
    tables.append_features(rows("a", "bb"), f"{scratch}/f", "01", "name")
    tables.append_features(rows("bb", "ccc", None), f"{scratch}/f", "2", "name")
    assert stored() == [("-", "2"), ("a", "01"), ("bb", "01"), ("ccc", "2")]

    broken = rows("dddd").withColumn("f", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tables.append_features(broken, f"{scratch}/f", "3", "name")
    assert len(stored()) == 4
    tables.append_features(rows("dddd"), f"{scratch}/f", "3", "name")
    tables.append_features(rows("a"), f"{scratch}/f", "01", "name")
    assert stored() == [("-", "2"), ("a", "01"), ("ccc", "2"), ("dddd", "3")]


def test_streamed_gaze_files(spark, scratch):
    from ocuspark.streaming import live

    rows = [(1, i, i * 4000, 0.5, 0.5, 0.5, 0.5, 1, 1) for i in range(3)]
    tables.write_gaze(spark.createDataFrame(rows, tables.GAZE_SCHEMA), f"{scratch}/in")
    s = live.with_event_time(tables.stream_gaze(spark, f"{scratch}/in"))
    assert live.run_available(live.clean(s, drop_invalid=True)).count() == 3


def test_pairs_by_stem(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    out = tables.pair_by_stem(paths("/i/a.png", "/i/a.jpg", "/i/b.png"), paths("/g/a.png", "/g/c.png"))
    assert [tuple(r) for r in out.collect()] == [("a", "/i/a.jpg", "/g/a.png")]
