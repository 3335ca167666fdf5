"""Columns about file names, formats, sizes and quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions that are decoded, those compared by their bytes only, what extensions say about loss
DECODED = ("wav", "wave", "aif", "aiff", "aifc", "mp3", "m4a", "m4b", "m4r", "aac", "adts", "caf", "flac", "alac", "ogg", "oga")
BYTES_ONLY = ("opus", "wma", "wv", "ape", "mka", "ra", "au", "snd", "amr", "ac3", "sd2")
LOSSLESS = ("flac", "alac", "wv", "ape", "wav", "wave", "aif", "aiff", "aifc")
LOSSY = ("mp3", "aac", "adts", "opus", "wma", "ra", "amr", "ac3", "ogg", "oga")
LABELS = {"opus": "Opus", "wma": "Windows Media Audio", "wv": "WavPack", "ape": "Monkey's Audio", "mka": "Matroska Audio", "ra": "RealAudio", "ac3": "AC-3", "amr": "AMR", "sd2": "Sound Designer II"}
CODECS = {"mp3": "MP3", "aac": "AAC", "alac": "Apple Lossless", "flac": "FLAC", "vorbis": "Ogg Vorbis", "pcm_alaw": "A-law", "pcm_mulaw": "µ-law"}
LOSSLESS_CODECS = ("pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be", "pcm_s32le", "pcm_s32be", "pcm_u8", "pcm_s8", "pcm_f32le", "pcm_f32be", "pcm_f64le", "pcm_f64be", "flac", "alac")


def fixed_text(value: Column, places: int) -> Column:
    """A number from 0 on with so many decimals, rounded from its exact binary value, ties to even.

    format_string rounds the shortest decimal that stands for a double, so 1.15, which lies below its
    decimal, would become 1.2. Here the product with the power of ten is kept exactly, as a double and its error.
    """
    power = float(10**places)
    scaled = value * 134217729.0  # splits the value into two halves of few bits
    high = scaled - (scaled - value)
    product = value * power
    error = (high * power - product) + (value - high) * power
    low = F.floor(product)
    over = (product - low - 0.5) + error
    n = low + F.when((over > 0) | (over == 0) & (low % 2 == 1), 1).otherwise(0)
    whole = F.floor(n / 10**places)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((n - whole * 10**places).cast("string"), places, "0"))


def extension_of(path: str | Column) -> Column:
    """Last extension in lower case, '' without one; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(display_name(path), r"^.+\.([^.]*)$", 1))


def display_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_path(path: str | Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def is_audio(path: str | Column) -> Column:
    return extension_of(path).isin(*DECODED, *BYTES_ONLY)


def is_byte_comparable_only(path: str | Column) -> Column:
    return extension_of(path).isin(*BYTES_ONLY)


def lossless_by_extension(extension: Column) -> Column:
    """True or false, null for containers and whatever else says nothing about the codec."""
    return F.when(extension.isin(*LOSSLESS), F.lit(True)).when(extension.isin(*LOSSY), F.lit(False))


def format_label(extension: Column) -> Column:
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.upper(extension))


def is_lossless_codec(codec: Column) -> Column:
    return codec.isin(*LOSSLESS_CODECS)


def codec_name(codec: Column, extension: Column) -> Column:
    pairs = [F.lit(x) for pair in CODECS.items() for x in pair]
    plain = F.when(is_lossless_codec(codec), F.concat(F.upper(extension), F.lit(" (PCM)"))).otherwise(F.upper(extension))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), codec), plain)


def meaningful_bit_depth(codec: Column, depth: Column) -> Column:
    """Null where the depth says nothing about quality."""
    return F.when(~F.coalesce(codec.isin("flac", "alac"), F.lit(False)) & (depth > 0), depth)


def bitrate_kbps(size: Column, duration: Column) -> Column:
    """Rounded kbit/s, null where the duration is unknown or next to nothing."""
    return F.when(duration > 0.05, F.round(size * 8 / duration / 1000)).cast("bigint")


def is_lossless(codec_flag: Column, extension: Column) -> Column:
    return F.coalesce(codec_flag, lossless_by_extension(extension))


def quality_summary(rate: Column, depth: Column, kbps: Column, lossless: Column) -> Column:
    """'44.1 kHz · 16-bit' for lossless files with known values, else 'N kbps', else a dash."""
    khz = F.regexp_replace(fixed_text(rate / 1000, 4), r"\.?0+$", "")
    lossless_text = F.concat_ws(" · ", F.when(rate > 0, F.concat(khz, F.lit(" kHz"))), F.when(depth > 0, F.concat(depth.cast("string"), F.lit("-bit"))))
    return F.when(F.coalesce(lossless, F.lit(False)) & (lossless_text != ""), lossless_text).when(kbps.isNotNull(), F.concat(kbps.cast("string"), F.lit(" kbps"))).otherwise("—")


def path_depth(path: str | Column) -> Column:
    """Components of a path; a leading slash counts as one."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")) + F.when(F.col(path).startswith("/") if isinstance(path, str) else path.startswith("/"), 1).otherwise(0)


def content_duration(duration: Column, lead: Column, trail: Column, truncated: Column) -> Column:
    """Seconds between the silences; what a truncated decode leaves unread isn't silence."""
    return F.greatest(F.lit(0.0), duration - lead - F.when(truncated, 0.0).otherwise(trail))


def skip_reason(extension: Column, error: Column, duration: Column, minimum: float) -> Column:
    # fixed output: the sentence of reports for formats that are compared by their bytes
    only_bytes = F.concat(F.lit("no "), format_label(extension), F.lit(" decoder available — only exact copies of this file can be found"))
    return (
        F.when(extension.isin(*BYTES_ONLY), only_bytes)
        .when(error.isNotNull(), error)
        .when(duration < minimum, F.lit(f"shorter than {minimum:g}s"))
    )


def format_bytes(size: Column) -> Column:
    """Powers of 1000 up to GB, one decimal from KB on."""
    out = F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(size < 1000 ** (power + 1), F.concat(fixed_text(size / float(1000**power), 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(fixed_text(size / 1e9, 1), F.lit(" GB")))


def format_duration(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; a dash for null."""
    whole = F.round(seconds).cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(whole.isNull() | (seconds < 0), "—").when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def badge(kind: Column, confidence: Column, level: Column) -> Column:
    return F.when(kind == "exact", "Identical").when(level == "perfect", "Same recording").otherwise(F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("% match")))
