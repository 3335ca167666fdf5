"""Queries of the recording-deduplication engine over the driver's tables.

The tables hold no audio, so documents stand in for recordings (three-word shingles are frames, the number
of characters is the file size), embeddings for band energies and event values for samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolot.functions import arrays, formats, signal
from echolot.operators import exact, groups, keep, matcher
from echolot.operators.graph import connected_components
from echolot.operators.order import with_order
from echolot.options import KeepRule, Level, MatchOptions, ScanOptions
from echolot.plans.scan import ScanResult
from echolot.runtime import materialize, table
from echolot.sources import audio, reports

#: Orders whose lines make a recording, and those at its beginning that are quiet; frames that a copy lacks.
RECORDING, QUIET, SHIFT = 2000, 50, 37
#: Embeddings are short recordings, all taken as stationary.
SHAPES = MatchOptions.for_level(Level.VERY_RELAXED, min_frames=1, stationary_flux=1e9)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file records."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("idx"), F.col("n_chars").alias("byte_size"), F.sha2("text", 256).alias("content_hash"), "source")


def fingerprints(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Documents as fingerprints: a 32-bit value for each three-word shingle. `more` are further columns over documents.

    The words pass through a generator, so that they are split once and not for every element.
    """
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", *(c.alias(n) for n, c in more.items()), F.explode(F.array(F.split("text", r"\s+"))).alias("w"))
    shingle = F.expr("transform(sequence(1, size(w) - 2), i -> cast(conv(substr(md5(concat_ws(' ', w[i - 1], w[i], w[i + 1])), 1, 8), 16, 10) AS bigint))")
    values = F.when(F.size("w") >= 3, shingle).otherwise(F.array().cast("array<bigint>"))
    return words.select(F.col("doc_id").alias("idx"), values.alias("values"), F.array().cast("array<smallint>").alias("shape"), F.lit(1.0).alias("flux"), F.lit(None).cast("double").alias("duration"), *more)


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.usable(fingerprints(spark, sf_dir), MatchOptions())


def _stored(fps: DataFrame) -> DataFrame:
    """Values fill the lower half of their bytes, which zstd makes use of."""
    return materialize(fps, "fps", "zstd")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.postings(_stored(_usable(spark, sf_dir)), MatchOptions())


# exact pass


def size_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_candidates(files(spark, sf_dir).select("idx", "byte_size")).select("idx", "byte_size")


def _exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of equal documents."""
    candidates = exact.size_candidates(files(spark, sf_dir))
    found = exact.exact_groups(candidates)
    return found, exact.exact_members(candidates, found)


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir)[1].select("rep", "idx")


def exact_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir)[0].select("rep", "content_hash", "files", "reclaimable")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.representatives(files(spark, sf_dir), _exact(spark, sf_dir)[1]).select("idx", "byte_size")


def attribute_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives are labelled; their copies take the label over."""
    own = files(spark, sf_dir)
    _, members = _exact(spark, sf_dir)
    first = exact.representatives(own, members).select("idx").withColumn("attribute", F.concat(F.lit("r"), F.col("idx").cast("string")))
    return exact.fill_from_representative(own.select("idx").join(first, "idx", "left"), members, ["attribute"]).select("idx", "attribute")


# similar pass


def frame_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = fingerprints(spark, sf_dir)
    xor = F.aggregate("values", F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseXOR(v))
    total = F.aggregate("values", F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return fps.select("idx", F.size("values").cast("bigint").alias("frames"), xor.alias("value_xor"), total.alias("value_sum"))


def key_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).groupBy("key").agg(F.count("*").alias("entries"), F.countDistinct("idx").alias("files"))


def bucket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = matcher.index_entries(_entries(spark, sf_dir), MatchOptions())
    return kept.groupBy("key").agg(F.count("*").alias("entries"))


def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matcher.pair_votes(_stored(_usable(spark, sf_dir)), MatchOptions())
    return found.select("a", "b", "votes", "offsets", F.col("n").alias("most"))


def best_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = MatchOptions()
    return matcher.pair_votes(_stored(_usable(spark, sf_dir)), options, options.min_votes).select("a", "b", "off", "n")


def aligned_ber(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = _stored(_usable(spark, sf_dir))
    checked = matcher.matched(fps, MatchOptions())
    return checked.select("a", "b", "off", "overlap", "errors", F.round("ber", 9).alias("ber"))


def _edges(spark: SparkSession, sf_dir: str, level: Level) -> DataFrame:
    options = MatchOptions.for_level(level)
    fps = _stored(_usable(spark, sf_dir))
    return matcher.temporal_edges(matcher.matched(fps, options), options)


def edges(spark: SparkSession, sf_dir: str, level: Level) -> DataFrame:
    return _edges(spark, sf_dir, level).select("a", "b", F.round("score", 9).alias("score"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_edges(spark, sf_dir, Level.VERY_STRICT).select("a", "b")).select(F.col("vertex").alias("idx"), "component")


def _similar(spark: SparkSession, sf_dir: str, level: Level) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, exact members, expanded similar groups), with the similar pass over representatives only."""
    own, found = files(spark, sf_dir), materialize(_exact(spark, sf_dir)[1], "exact")
    options = MatchOptions.for_level(level)
    fps = _stored(exact.representatives(_usable(spark, sf_dir), found))
    linked = materialize(matcher.temporal_edges(matcher.matched(fps, options), options), "edges")
    return own, found, groups.expand_similar(matcher.groups_of(linked), found)


def group_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = materialize(_edges(spark, sf_dir, Level.VERY_RELAXED), "edges")
    found = matcher.groups_of(linked).groupBy("rep").agg(F.count("*").alias("files"), F.min("confidence").alias("confidence"))
    return found.select("rep", "files", F.round("confidence", 9).alias("confidence"))


def absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups that no similar group holds."""
    _, found, similar = _similar(spark, sf_dir, Level.VERY_STRICT)
    return groups.absorb_exact(found, similar).groupBy("rep").agg(F.count("*").alias("files"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found, similar = _similar(spark, sf_dir, Level.VERY_STRICT)
    return groups.ranked(groups.all_groups(found, similar), own)


def groups_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("kind", "rep", "files", "reclaimable", F.round("confidence", 3).alias("confidence"))


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = files(spark, sf_dir).agg(F.count("*").alias("files_scanned"))
    return groups.summary(_ranked(spark, sf_dir)).crossJoin(scanned)  # one row each


def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the strictest and the most relaxed level, by the first file of each group; one alignment serves both."""
    fps = _stored(_usable(spark, sf_dir))
    checked = materialize(matcher.matched(fps, MatchOptions()), "aligned")
    a, b = (matcher.temporal_edges(checked, MatchOptions.for_level(x)).groupBy("a").agg(F.count("*").alias("n")) for x in (Level.PERFECT, Level.VERY_RELAXED))
    return groups.compare_reports(a, b, "a", "n")


# shape and signal


def _band_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    bands = F.slice("embedding", 1, 33).cast("array<double>")
    frames = vectors.select("vec_id", F.coalesce(F.col("label").cast("bigint"), F.lit(-1)).alias("idx"), bands.alias("bands"))
    return frames.withColumn("previous", F.lag("bands").over(Window.partitionBy("idx").orderBy("vec_id")))


def band_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _band_frames(spark, sf_dir).where("previous IS NOT NULL")
    return frames.select("vec_id", arrays.band_bits(F.col("bands"), F.col("previous")).alias("bits"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _band_frames(spark, sf_dir).withColumn("change", F.when(F.col("previous").isNotNull(), arrays.flux(F.col("bands"), F.col("previous"))))
    by_file = frames.groupBy("idx").agg(F.collect_list("change").alias("changes"), F.count("change").alias("n"))
    means = frames.select("idx", F.posexplode("bands").alias("m", "e")).groupBy("idx", "m").agg(F.avg("e").alias("mean"))
    means = means.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("m", "mean"))).alias("ms")).select("idx", F.col("ms.mean").alias("means"))
    joined = by_file.join(means, "idx")
    return joined.select("idx", "n", arrays.upper_median(F.col("changes")).alias("flux"), arrays.shape_template(F.col("means")).alias("shape"))


def flux_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("idx", "n", F.round("flux", 9).alias("flux"))


def stationary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = MatchOptions().stationary_flux
    return _shapes(spark, sf_dir).select("idx", (F.col("n") >= MatchOptions().min_frames).alias("usable"), (F.col("flux") < limit).alias("stationary"))


def shape_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("idx", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"))


def shape_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = _shapes(spark, sf_dir).select("idx", F.expr("array_repeat(0L, cast(n AS int))").alias("values"), "shape", "flux", F.lit(None).cast("double").alias("duration"))
    return matcher.shape_edges(fps, SHAPES).select("a", "b", F.round("score", 9).alias("score"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of each user in order of time."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    packed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return packed.select("user_id", F.col("s.value").alias("x"))


def _with_kernel(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """A kernel of the front end over each row's key and samples (x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0].strip("`") for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for key, x in zip(batch.iloc[:, 0], batch["x"], strict=True) for r in kernel(key, np.asarray(x))], columns=names)

    return df.mapInPandas(run, schema)


def silence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open range between the silences of each signal."""
    return _with_kernel(_signals(spark, sf_dir), lambda key, x: [(key, len(x), *signal.content_range(x))], "user_id bigint, n bigint, start bigint, `end` bigint")


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of RECORDING orders each as samples in -1..1; the first QUIET orders are all but silent."""
    order = F.col("l_orderkey")
    loud = (F.col("l_extendedprice") - 53000) / 52000 * F.when(order % RECORDING < QUIET, 0.001).otherwise(1.0)
    lines = table(spark, sf_dir, "lineitem").select(F.floor(order / RECORDING).alias("rec"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", loud.alias("v")).alias("s"))
    return lines.groupBy("rec").agg(F.array_sort(F.collect_list("s")).alias("s")).select("rec", F.col("s.v").alias("x"))  # lines of so many orders


def recording_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence, frames, spectral shape, change and bits of each recording, by the front end that scans use."""

    def kernel(key: int, x: np.ndarray) -> list[tuple]:
        found, _, _ = signal.analyze(x)
        start, end = signal.content_range(x)
        value = int(np.bitwise_xor.reduce(found.values)) if len(found.values) else 0
        return [(key, len(x), start, end, signal.frame_count(end - start), ",".join(map(str, found.shape)), round(min(found.flux, 1e9), 3), value)]

    return _with_kernel(_recordings(spark, sf_dir), kernel, "rec bigint, samples bigint, start bigint, `end` bigint, frames bigint, shape string, flux double, value_xor bigint")


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over recordings taken as stereo at 44.1 kHz, mixed down and brought to the fingerprint's rate."""

    def kernel(key: int, x: np.ndarray) -> list[tuple]:
        mono = signal.downmix(x[: len(x) // 2 * 2].reshape(-1, 2).astype(np.float32))
        out = signal.resample(mono, 44100, signal.RATE).astype(float)
        return [(key, len(mono), len(out), round(out.sum(), 2), round(np.abs(out).sum(), 2))]

    return _with_kernel(_recordings(spark, sf_dir), kernel, "rec bigint, frames bigint, samples bigint, total double, magnitude double")


def fixed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the bands, and the energy of the window by blocks of 256 samples."""
    edges, window = signal.band_edges(), signal.window().astype(float)
    rows = [("edge", i, float(e)) for i, e in enumerate(edges)] + [("window", i, round(float((w**2).sum()), 2)) for i, w in enumerate(window.reshape(-1, 256))]
    return spark.createDataFrame(rows, "kind string, place bigint, value double")


def best_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offset over all, between the first of equal documents and each other one without its first SHIFT frames."""
    fps = _usable(spark, sf_dir).select("idx", "values")
    pairs = exact_groups(spark, sf_dir).where("rep <> idx")
    both = pairs.join(fps.select(F.col("idx").alias("rep"), F.col("values").alias("x")), "rep").join(fps, "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signal.best_alignment(np.asarray(x), np.asarray(y)[SHIFT:]) or (None, None, None) for x, y in zip(batch["x"], batch["values"], strict=True)]
            yield pd.DataFrame([(a, b, *f) for a, b, f in zip(batch["rep"], batch["idx"], found, strict=True)], columns=["rep", "idx", "ber", "off", "overlap"])

    return both.select("rep", "idx", "x", "values").mapInPandas(run, "rep bigint, idx bigint, ber double, off bigint, overlap bigint")


def _sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as WAV files of 8-bit samples at 8 kHz; a data size beyond the end reads to the end."""
    header = "52494646FFFFFFFF57415645666D742010000000" + "01000100401F0000401F000001000800" + "64617461FFFFFFFF"
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("idx"), F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.concat(F.unhex(F.lit(header)), F.encode("text", "UTF-8")).alias("content"))


def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.probe(_sound_files(spark, sf_dir))


def analysed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration, cut and skip reason of files, of which at most half a second is read and a tenth asked for."""
    found = audio.analyze_content(_sound_files(spark, sf_dir), 0.1, 0.5)
    return found.select("idx", "duration", "truncated", "sample_rate", "bit_depth", "channel_count", "codec", "codec_is_lossless", "error")


def pcm_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of at most a tenth of a second at the files' own rate."""
    found = audio.decode(_sound_files(spark, sf_dir), 8000.0, 0.1)
    total = F.aggregate(F.transform("samples", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return found.select("idx", F.when(F.col("samples").isNotNull(), F.size("samples")).alias("n"), F.when(F.col("samples").isNotNull(), total).alias("total"), "error")


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of both kinds with the better score, where every other document counts as stationary."""
    digit = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: (F.instr(F.lit("0123456789abcdef"), F.substr("h", i, F.lit(1))) * 17 - 17).cast("smallint"))
    made = fingerprints(spark, sf_dir, h=F.md5("text"), seconds=F.col("n_chars") / 50.0)
    flux = F.when(F.col("idx") % 2 == 0, 0.05).otherwise(1.0)
    fps = _stored(made.select("idx", "values", digit.alias("shape"), flux.alias("flux"), F.col("seconds").alias("duration")))
    return matcher.match_edges(fps, MatchOptions.for_level(Level.VERY_RELAXED)).select("a", "b", F.round("score", 9).alias("score"))


# keep rules


def _group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents with attributes of recordings, some of them unknown."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hashed = docs.withColumn("h", F.sha2("text", 256))
    reps = hashed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    rows = hashed.join(reps, "h").join(labels, "doc_id", "left")
    return rows.select(
        "rep",
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("/"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit("/"))).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        (F.col("n_chars") + F.col("doc_id") % 5).alias("byte_size"),
        (F.col("doc_id") * 7919 % 1000).alias("modified"),
        F.when(F.col("quality").isNotNull(), F.col("n_chars") / 100.0 + F.col("doc_id") % 7).alias("duration"),
        F.when(F.col("quality").isNotNull(), F.col("n_chars") / 100.0 + F.col("doc_id") % 7).alias("content_duration"),
        F.when(F.col("doc_id") % 4 != 0, F.lit(44100.0) + F.col("doc_id") % 2 * 3900).alias("sample_rate"),
        F.when(F.col("doc_id") % 3 != 0, F.lit(8) + F.col("doc_id") % 3 * 8).alias("bit_depth"),
        (F.lit(1) + F.col("doc_id") % 2).alias("channel_count"),
        (F.col("quality") == 1).alias("lossless"),
    )


def keep_rule(spark: SparkSession, sf_dir: str, rule: KeepRule) -> DataFrame:
    return keep.keepers(_group_rows(spark, sf_dir), rule).select("rep", "idx")


def mark_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to remove under the best-quality rule, with the reason's keeper; a plan, nothing is deleted."""
    rows = _group_rows(spark, sf_dir)
    kept = keep.keepers(rows, KeepRule.BEST_QUALITY)
    marked = keep.refuse_empty_groups(rows, keep.marks(rows, KeepRule.BEST_QUALITY))
    return marked.join(kept.withColumnRenamed("idx", "keeper"), "rep").select("rep", "idx", "byte_size", "keeper")


def marked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.marks(_group_rows(spark, sf_dir), KeepRule.LARGEST).agg(F.count("*").alias("marked"), F.sum("byte_size").alias("bytes"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over groups of copies, numbered in its order."""
    rows = _group_rows(spark, sf_dir)
    files = materialize(rows.drop("rep").withColumn("codec_is_lossless", F.col("lossless")).drop("lossless"), "files")
    membership = materialize(rows.select(F.lit("exact").alias("kind"), "rep", "idx", F.lit(1.0).alias("confidence")), "groups")
    made = reports.report_groups(ScanResult(files, groups.ranked(membership, files), membership, spark.createDataFrame([], "name string, reason string"), ScanOptions()))
    joined = F.array_join("paths", "|")
    flat = made.select("kind", joined.alias("paths"), F.col("reclaimableBytes").alias("reclaimable"), *(F.col("keepers")[r.label].alias(r.value.replace("-", "_")) for r in KeepRule))
    return with_order(flat, [F.col("kind"), F.col("paths")], "place")


def groups_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _group_rows(spark, sf_dir)
    made = rows.select(F.lit("exact").alias("kind"), "rep", "idx", F.lit(1.0).alias("confidence"))
    left = groups.after_removal(made, keep.keepers(rows, KeepRule.OLDEST))
    return left.groupBy("rep").agg(F.count("*").alias("files"))


# projections


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", formats.display_name("url").alias("name"), formats.folder_path("url").alias("folder"), formats.extension_of("url").alias("extension"), formats.path_depth("url").cast("bigint").alias("depth"), F.length("url").cast("bigint").alias("length"))


def bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("duration"), F.col("l_extendedprice").cast("double").alias("size"))
    kbps = formats.bitrate_kbps(F.col("size"), F.col("duration") - 1)
    return orders.select("l_orderkey", "l_linenumber", kbps.alias("kbps"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _group_rows(spark, sf_dir)
    kbps = formats.bitrate_kbps(F.col("byte_size"), F.col("duration"))
    return rows.select("idx", formats.quality_summary(F.col("sample_rate"), F.col("bit_depth"), kbps, F.col("lossless")).alias("summary"))


def format_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "exact").otherwise("similar")
    level = F.when(F.col("doc_id") % 2 == 0, "perfect").otherwise("strict")
    return docs.select("doc_id", formats.format_bytes(F.col("n_chars") * 1000).alias("bytes"), formats.format_duration(F.col("n_chars") * 1.0).alias("duration"), formats.badge(kind, (F.col("doc_id") % 101) / 100, level).alias("badge"))


CODEC_ROWS = [(c, e, d) for c in ("pcm_s16le", "pcm_u8", "pcm_f32be", "flac", "alac", "mp3", "aac", "vorbis", "pcm_alaw", "pcm_mulaw", "opus", "wmav2") for e, d in (("wav", 16), ("m4a", 0), ("ogg", None), ("opus", 24))]


def codec_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What codecs, with and without a known flag, say about name, loss and depth, and why files are skipped."""
    made = spark.createDataFrame(CODEC_ROWS, "codec string, ext string, depth int")
    codec, ext, error = F.col("codec"), F.col("ext"), F.when(F.col("depth") == 24, F.lit("broken"))
    flag = F.when(F.col("depth").isNotNull(), formats.is_lossless_codec(codec))
    return made.select("codec", "ext", "depth", formats.codec_name(codec, ext).alias("name"), formats.is_lossless_codec(codec).alias("lossless_codec"), formats.meaningful_bit_depth(codec, F.col("depth")).alias("meaningful"), formats.is_lossless(flag, ext).alias("lossless"), formats.skip_reason(ext, error, F.col("depth") / 10.0, 2.0).alias("reason"))


def content_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    found = formats.content_duration(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_returnflag") == "R")
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(found), 3).alias("seconds"), F.sum((found == 0).cast("bigint")).alias("empty"))


def format_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extensions say, over all known ones and a few others."""
    names = [*formats.DECODED, *formats.BYTES_ONLY, "txt", "", "MP3"]
    made = spark.createDataFrame([(f"/music/song.{n}" if n else "/music/song",) for n in names], "path string")
    ext = formats.extension_of("path")
    return made.select("path", ext.alias("extension"), formats.is_audio("path").alias("is_audio"), formats.is_byte_comparable_only("path").alias("bytes_only"), formats.lossless_by_extension(ext).alias("lossless"), formats.format_label(ext).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        size_candidates, exact_groups, exact_reclaimable, representatives, attribute_fill, frame_values, key_postings, bucket_filter, vote_counts, best_offset, aligned_ber,
        components, group_confidence, absorption, groups_ranked, summary_counts, report_diff, band_bits, flux_median, stationary_flag, shape_template, shape_pairs,
        silence_trim, recording_prints, resampled, fixed_tables, best_alignments, probe_files, analysed_files, pcm_dump, match_scores, mark_plan, report_rows, marked_totals, groups_after_removal, url_parts, bitrate, quality_summary, format_texts, format_facts, codec_facts, content_seconds,
    )
}
QUERIES |= {f"edges_{level.value.replace('-', '_')}": partial(edges, level=level) for level in Level}
QUERIES |= {f"keep_{rule.value.replace('-', '_')}": partial(keep_rule, rule=rule) for rule in KeepRule}
