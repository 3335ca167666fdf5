from pyspark.sql import functions as F

from echolot.functions import arrays, formats


def test_paths_and_formats(spark):
    df = spark.createDataFrame([("/m/Song.One.FLAC",), ("/m/.hidden",), ("/m/plain",), ("/m/x.m4a",)], "path string")
    ext = formats.extension_of("path")
    got = [tuple(r) for r in df.select(ext, formats.lossless_by_extension(ext), formats.format_label(ext), formats.folder_path("path"), formats.path_depth("path")).collect()]
    assert got == [("flac", True, "FLAC", "/m", 3), ("", None, "", "/m", 3), ("", None, "", "/m", 3), ("m4a", None, "M4A", "/m", 3)]


def test_codecs(spark):
    df = spark.createDataFrame([("pcm_s16le", "wav", 16), ("flac", "flac", 16), ("pcm_alaw", "wav", 8), ("opus", "opus", 0), ("alac", "m4a", 24)], "codec string, ext string, depth int")
    codec = F.col("codec")
    got = [tuple(r) for r in df.select(formats.codec_name(codec, F.col("ext")), formats.is_lossless_codec(codec), formats.meaningful_bit_depth(codec, F.col("depth"))).collect()]
    assert got == [("WAV (PCM)", True, 16), ("FLAC", True, None), ("A-law", False, 8), ("OPUS", False, None), ("Apple Lossless", True, None)]


def test_durations(spark):
    df = spark.createDataFrame([(10.0, 1.0, 2.0, False), (10.0, 1.0, 2.0, True), (1.0, 2.0, 0.0, False)], "d double, l double, t double, cut boolean")
    assert [r[0] for r in df.select(formats.content_duration(F.col("d"), F.col("l"), F.col("t"), F.col("cut"))).collect()] == [7.0, 9.0, 0.0]
    times = spark.createDataFrame([(59.5,), (3661.0,), (None,)], "s double")
    assert [r[0] for r in times.select(formats.format_duration(F.col("s"))).collect()] == ["1:00", "1:01:01", "—"]


def test_sizes_round_the_exact_binary_value(spark):
    sizes = [0, 999, 1000, 1150, 1250, 1350, 1_150_000, 1_250_000, 2_650_000, 999_950, 1_250_000_000, 3_049_999, 7_350_000, 10**15]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", formats.format_bytes(F.col("n")).alias("t")).collect()

    def text(n):
        for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
            if n >= 1000**power:
                return f"{n / 1000**power:.1f} {unit}"
        return f"{n} B"

    assert [r.t for r in rows] == [text(r.n) for r in rows] and text(1_150_000) == "1.1 MB" and text(1_250_000) == "1.2 MB"
    some = spark.range(20_000).select("id", formats.fixed_text(F.col("id") / 1000, 1).alias("a"), formats.fixed_text(F.col("id") * 0.0137, 4).alias("b"))
    assert all(r.a == f"{r.id / 1000:.1f}" and r.b == f"{r.id * 0.0137:.4f}" for r in some.collect())


def test_upper_median(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([3.0, 1.0, 2.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(arrays.upper_median(F.col("x"))).collect()] == [3.0, 2.0, 3.4028234663852886e38]
