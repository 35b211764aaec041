"""Files: sample widths, line numbers over splits, prefixes that are plain text, signals written by tasks."""

import io
import wave

import numpy as np
import pytest

from hedgerow.sources import readers, writers


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(spark, tmp_path, width):
    """Silence, a ramp and both ends, in two channels."""
    x = np.array([0, 0.5, -0.5, -1, 1 - 2.0 ** (1 - 8 * width)])
    whole = np.round(x * 2.0 ** (8 * width - 1)).astype(np.int64)
    raw = (whole + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in whole)
    stereo = b"".join(raw[i * width : (i + 1) * width] * 2 for i in range(len(x)))
    (tmp_path / "a").mkdir()
    with wave.open(str(tmp_path / "a" / "s.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(width)
        f.setframerate(8000)
        f.writeframes(stereo)
    (row,) = readers.audio(spark, str(tmp_path / "a")).collect()
    assert row.rate == 8000 and np.allclose(row.samples, x, atol=1e-6)


def test_signals_written_by_tasks(spark, tmp_path):
    rows = [(1, [0.0, 0.5, -2.0, 2.0], 8000), (2, [], 16000), (3, None, 16000), (4, [0.25] * 1000, 44100)]
    df = spark.createDataFrame(rows, "name long, samples array<double>, rate int").repartition(3)
    done = {r.name: r for r in writers.audio_files(df, f"file://{tmp_path}/w").collect()}
    assert set(done) == {"1", "2", "3", "4"} and sorted(p.name for p in (tmp_path / "w").iterdir()) == ["1.wav", "2.wav", "3.wav", "4.wav"]
    again = {r.name: r.sha256 for r in writers.audio_files(df, f"file://{tmp_path}/w").collect()}
    assert again == {n: r.sha256 for n, r in done.items()}  # a task that runs again writes the same
    back = {r.path.rsplit("/", 1)[1]: r for r in readers.audio(spark, str(tmp_path / "w")).collect()}
    assert np.allclose(back["1.wav"].samples, np.array([0, 16384, -32767, 32767]) / 32768) and back["1.wav"].rate == 8000
    assert back["2.wav"].samples == [] and back["3.wav"].samples == [] and len(back["4.wav"].samples) == 1000


def test_line_numbers_over_splits(spark, tmp_path):
    bad = {3, 500, 501, 1999}
    lines = ["" if i == 7 else '{"id": ' if i in bad else f'{{"id": {i}, "x": "é{i}"}}' for i in range(1, 2001)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "f" / "b.json").write_text('{"id": 1}\nno json')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        got = readers.jsonl_errors(spark, str(tmp_path / "f"), "id long, x string")
        assert got.rdd.getNumPartitions() > 0 and spark.read.text(str(tmp_path / "f")).rdd.getNumPartitions() > 5
        assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in got.collect()) == sorted([("a.json", i) for i in bad] + [("b.json", 2)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_prefixes_are_plain_text(spark):
    df = spark.createDataFrame([("/data.v1/a",), ("/dataXv1/a",), ("/data.v1",), (None,), ("/x[1]/b",)], "p string")
    assert [r.p for r in readers.migrate(df, ["p"], "/data.v1", "/new").collect()] == ["/new/a", "/dataXv1/a", "/new", None, "/x[1]/b"]
    assert [r.p for r in readers.migrate(df, ["p"], "/x[1]", "/$1").collect()][-1] == "/$1/b"
    listing = spark.createDataFrame([("/y/b",), ("/dataXv1/a",)], "path string")
    got = {r.p: r.resolved for r in readers.resolve(df, "p", listing, ["/root"], {"/x[1]": "/y", "/data.v1": "/dataXv1"}).collect()}
    assert got == {"/data.v1/a": "/dataXv1/a", "/dataXv1/a": "/dataXv1/a", "/data.v1": None, None: None, "/x[1]/b": "/y/b"}


def test_unknown_width():
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(1)
        f.writeframes(b"\0\0")
    data = bytearray(raw.getvalue())
    data[34] = 64  # bits per sample
    with pytest.raises((ValueError, wave.Error)):
        readers._wave(bytes(data))
