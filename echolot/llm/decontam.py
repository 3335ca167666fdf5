"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of `window` words. A document contains a window only if it contains every
shingle of it, so one shingle per window, the rarest in the corpus, suffices as its prefix. Documents are
exploded to shingle positions, joined to the prefixes, cut by positional and length bounds (the window
must fit around the shingle), and the candidate words are compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolot.llm.joins import is_small
from echolot.runtime import materialize

#: Words of a window, words of a shingle.
WINDOW, SHINGLE = 10, 3
#: Rows up to which a table made of the benchmark is broadcast, if its bytes allow it; beyond that it is shuffled.
BROADCAST_ROWS = 200_000
#: What lies between lower-case words, which are runs of letters, digits and whatever lies beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: str | Column) -> Column:
    """Words by splitting, which reads a text once; extracting all matches copies it for every match."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), BETWEEN), "")


def _shingle(words: str, at: str, size: int) -> Column:
    return F.xxhash64(*(F.expr(f"get({words}, {at} + {i})") for i in range(size)))


def item_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, w, len): every window of every item; a shorter item that has words is one window."""
    items = benchmark.select(F.col(item).alias("item_id"), words_of(text).alias("words")).where("size(words) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    return items.select("item_id", "words", starts.alias("s")).select(
        "item_id", F.slice("words", F.col("s"), F.least(F.size("words"), F.lit(window))).alias("w"), F.least(F.size("words"), F.lit(window)).alias("len")
    )


def _positions(docs: DataFrame, size: int, sentinel: bool) -> DataFrame:
    """(doc_id, words, pos) for every shingle of `size` words, with pos = -1 once per document if asked for.

    The words are computed below the generator, so each text is split once however often they are used.
    """
    low, split = (-1 if sentinel else 0), docs.select("doc_id", words_of("text").alias("words"))
    span = F.expr(f"CASE WHEN size(words) >= {size} THEN sequence({low}, size(words) - {size}) {'ELSE array(-1)' if sentinel else ''} END")
    return split.select("doc_id", "words", F.explode(span).alias("pos"))


def _broadcastable(df: DataFrame) -> tuple[DataFrame, bool]:
    small = is_small(df, BROADCAST_ROWS)
    return (F.broadcast(df) if small else df), small


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact containment of item windows in documents, word by word.

    Null texts, documents or items, have no words and no hits. Repeated items count by their id, repeated
    windows once. Rows that repeat a key with the same text are one document; with different texts their
    hits are joined and the larger word count stands. Null keys form one document of their own. Long texts are
    read whole. Further columns are ignored; without documents the result is empty, without items nothing is hit.

    Returns doc_id, n_words, n_hit (words inside some occurrence), n_items, items (sorted ids as one
    string), spans (occurrences as start and length, by start).
    """
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    owners = materialize(item_windows(benchmark, window, item, item_text).withColumn("wkey", F.md5(F.array_join("w", " "))), "windows")
    windows = owners.groupBy("wkey").agg(F.first("w").alias("w"), F.first("len").alias("len"))
    size = F.least(F.col("len"), F.lit(shingle))
    offsets = F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size")))
    sized = windows.withColumn("size", size).select("wkey", "w", "len", "size", offsets.alias("off"))
    hashed = F.coalesce(*(F.when(F.col("size") == k, _shingle("w", "off", k)) for k in range(1, shingle + 1)))
    tokens = materialize(sized.withColumn("token", hashed), "shingles")
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())  # at most `shingle` numbers

    # how often each benchmark shingle occurs in the corpus
    counted = []
    for k in sizes:
        wanted, _ = _broadcastable(tokens.where(F.col("size") == k).select("token").distinct())
        at = _positions(source, k, False).select(_shingle("words", "pos", k).alias("token"))
        counted.append(at.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df")).withColumn("size", F.lit(k)))
    if counted:
        frequency = reduce(DataFrame.unionByName, counted)
        rarest = tokens.join(frequency, ["token", "size"], "left").groupBy("wkey").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "token", "size", "w", "len")).alias("m"))
        prefixes = rarest.where("m.df > 0").select("wkey", "m.off", "m.token", "m.size", "m.w", "m.len")  # an absent shingle rules its window out
    else:
        prefixes = tokens.select("wkey", "off", "token", "size", "w", "len")
    prefixes = materialize(prefixes, "prefixes")

    found = []
    fits = "pos >= off AND pos - off + len <= size(words) AND slice(words, pos - off + 1, len) = w"
    for number, k in enumerate(sizes or [1]):
        own, small = _broadcastable(prefixes.where(F.col("size") == k).select("wkey", "off", "token", "w", "len"))
        sentinel = own.sparkSession.createDataFrame([(None, 0, 0, None, 0)], own.schema)  # meets the one row of each document
        at = _positions(source, k, number == 0)
        if small:
            build = F.broadcast(own.unionByName(sentinel)) if number == 0 else own
            at = at.withColumn("token", F.when(F.col("pos") < 0, F.lit(0).cast("bigint")).otherwise(_shingle("words", "pos", k)))
            hit = at.join(build, "token").where(f"(pos < 0 AND wkey IS NULL) OR (pos >= 0 AND wkey IS NOT NULL AND {fits})")
            found.append(hit.select("doc_id", F.size("words").cast("bigint").alias("n_words"), (F.col("pos") - F.col("off")).alias("start"), "len", "wkey"))
        else:  # candidates without their texts are shuffled, and the texts come back for the comparison
            light = at.where("pos >= 0").select("doc_id", "pos", _shingle("words", "pos", k).alias("token")).join(own, "token")
            split = source.select("doc_id", words_of("text").alias("words"))
            both = split.alias("d").join(light.alias("c"), F.expr("d.doc_id <=> c.doc_id")).where(fits)
            found.append(both.select("d.doc_id", F.size("words").cast("bigint").alias("n_words"), (F.col("pos") - F.col("off")).alias("start"), "len", "wkey"))
            if number == 0:
                found.append(split.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.lit(-1).alias("start"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("wkey")))
    matches = materialize(reduce(DataFrame.unionByName, found), "matches")

    hits = matches.where("wkey IS NOT NULL")
    stops = hits.select("doc_id", "start", "len").distinct().withColumn("stop", F.col("start") + F.col("len"))
    earlier = F.max("stop").over(Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(earlier, F.lit(0))))
    spans = stops.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "len"))).alias("spans"))
    names = hits.select("doc_id", "wkey").distinct().join(owners.select("wkey", F.col("item_id").cast("string").alias("item")).distinct(), "wkey")
    items = names.select("doc_id", "item").distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    whole = matches.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    pieces = whole.unionByName(spans, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)
    return pieces.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.max("n_hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.max("n_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.max("items"), F.lit("")).alias("items"),
        F.max("spans").alias("spans"),
    )
