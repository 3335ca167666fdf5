import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from echolot.llm import oracles, queries
from echolot.runtime import materialize

DATA = Path("/root/testdata/sf0.001")


def corpus(spark, folder):
    rng = random.Random(2)
    make = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 4))) for _ in range(n))
    languages = {"en": ["the", "ing", "er", "on"], "fr": ["eau", "é", "qu", "le"]}
    rows = [[i, "\n".join(make(languages[lang], 30) for _ in range(4)), lang, "s", 0] for i in range(60) for lang in [rng.choice(["en", "fr"])]]
    for i in range(20, 34):
        rows[i][1] += "\nAll rights reserved by the owner."
    item = make(languages["en"], 25)
    rows[40][1] += "\n" + item
    rows += [[100 + i, rows[i][1], rows[i][2], "s", 0] for i in range(5)]
    rows += [[200, None, "en", "s", 0], [201, "", "en", "s", 0], [202, "12 34", "en", "s", 0]]
    spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "lines":
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert sum("All rights" in t for t, _ in texts.values()) == 1 and all(n == len(t) for t, n in texts.values())
    everything = set(range(60)) | set(range(100, 105))
    assert kept[0] == everything and kept[1] == everything
    assert kept[2] == set(range(60)) and kept[3] == kept[2] - {40} and kept[4] == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_odd_tables(spark, tmp_path):
    """Clashing names, repeated ids, nulls, long texts and an empty table."""
    corpus(spark, tmp_path)
    names = ["lang_pred", "kept", "n_lines", "n_removed", "rows", "key", "hash", "row", "carried", "place", "id", "text_id", "keeper", "size", "part", "sequence_id", "with.dot"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first, second = (docs.where(f"doc_id = {k}").collect()[0].text for k in (7, 11))
    more = [(7, second + " once more", "en", "s", 1), (7, first, "en", "s", 2), (None, first, "en", "s", 3), (300, (first + "\n") * 500, "en", "s", 4), (301, None, None, None, None), (302, "", "en", "s", 0)]
    wide = docs.union(spark.createDataFrame(more, docs.schema))
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(k))
    kept = wide
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, kept.limit(0), str(tmp_path)), name)
        assert empty.count() == 0
        kept = materialize(stage(spark, kept, str(tmp_path)), name)
        if name == "packing":
            assert empty.columns == kept.columns
        else:
            assert kept.columns == empty.columns == wide.columns
            assert all(r[n] == k for r in kept.collect() for k, n in enumerate(names))
        if name == "near_duplicates":
            found = [(r.doc_id, r.n_chars) for r in kept.collect()]
            again = materialize(stage(spark, previous.repartition(7), str(tmp_path)), name)
            assert sorted((r.doc_id, r.text) for r in again.collect()) == sorted((r.doc_id, r.text) for r in kept.collect())
            assert sum(d == 7 for d, _ in found) <= 2 and None not in [d for d, _ in found]
        previous = kept


@pytest.mark.skipif(not DATA.exists(), reason="tables not here")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df, want = queries.QUERIES[name](spark, str(DATA)), con.sql(oracles.ORACLES[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="tables not here")
def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
