"""The pipeline on small tables, and its registration."""

import zlib

import pytest

import __spark_entry__
import corpus_pipeline
from weft.llm import decontamination, simhash

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path_factory):
    import random

    from tests.llm.conftest import prose

    rng, d = random.Random(11), tmp_path_factory.mktemp("sf")
    clean = [(i, prose(rng, 80).capitalize() + ".") for i in range(200)]
    item = prose(rng, 40)
    copies = [(300 + i, t) for i, t in clean[:10]] + [(320 + i, t[:-8]) for i, t in clean[10:20]]
    junk = [(400 + i, (prose(rng, 1) + "### ") * 60) for i in range(60)]
    leaks = [(500 + i, prose(rng, 60) + " " + item + " " + prose(rng, 60)) for i in range(5)]
    none = [(600, None), (601, ""), (602, "123 456")]
    rows = clean + copies + junk + leaks + none
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in clean + junk if zlib.crc32(str(i).encode()) % 7], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(d))
        assert out.columns == docs.columns, k
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(d)).collect()}
    assert got.keys() == {i for i, _ in clean}
    from weft.llm.bpe import loaded
    from weft.llm.entries import vocabulary

    own = loaded(vocabulary("word_bpe_49k.json"))
    for i, t in clean[:20]:
        assert got[i]["ids"] == own.ids(t) and got[i]["n_tokens"] == len(got[i]["ids"])


def test_stages_on_empty_and_repeated_rows(spark, docs, empty, tmp_path):
    docs.select("doc_id").limit(0).selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    twice = docs.unionByName(docs)
    kept = {name: stage(spark, twice, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES}
    n = docs.count()
    assert kept["quality"] == kept["decontamination"] == kept["bpe"] == 2 * n  # without labels every score is 0.5
    assert kept["near_dedup"] == docs.filter("doc_id is null or doc_id not in (901, 902, 903, 906)").count() + 2
    assert kept["language"] == 2 * corpus_pipeline.language_id(spark, docs, str(tmp_path)).count()


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert decontamination.STEP and simhash.BLOCKS  # the stages' operators are those of the queries
