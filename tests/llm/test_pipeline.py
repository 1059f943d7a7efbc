"""The pipeline's stages on the smallest tables."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "personal_data", "mixing", "bpe"]
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, SF).columns == docs.columns
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.exceptAll(docs).isEmpty() and docs.exceptAll(mixed).isEmpty()
    left = stages["near_copies"](spark, docs, SF)
    assert stages["near_copies"](spark, left, SF).count() == left.count() < docs.count()
    assert stages["personal_data"](spark, docs, SF).where("text rlike '@mail'").isEmpty()
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= left.count()
    assert out.where(F.size("tokens") != F.col("n_tokens")).isEmpty()


def test_run_against_its_stages_one_by_one(spark):
    """Every decision of a stage, made anew by plain code on its input, is seen in the result of run()."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from breezeline.llm import bpe, mixing

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages["toxicity"](spark, docs, SF).cache()
    left = kept.select("doc_id", "text").collect()

    def shingles(text):
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
        return set(zip(*(w[i:] for i in range(5)))) if len(w) > 4 else {tuple(w)} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in left}
    name = {i: i for i in sets}
    names = sorted(sets)
    changed = True
    links = [
        (i, j) for n, i in enumerate(names) for j in names[n + 1 :]
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(name[i], name[j])
            changed |= name[i] != low or name[j] != low
            name[i] = name[j] = low
    firsts = {i for i in names if name[i] == i}
    clean = stages["personal_data"](spark, kept.where(F.col("doc_id").isin(*firsts)), SF)
    order = [r["doc_id"] for r in mixing.mixed(clean).orderBy("slot", "offset").select("doc_id").collect()]
    path = bpe.default_path(spark)
    coding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}
    )
    texts = {r["doc_id"]: r["text"] or "" for r in clean.select("doc_id", "text").collect()}
    out = corpus_pipeline.run(spark, SF).orderBy("position").collect()
    assert {r["doc_id"] for r in out} == firsts and len(links) > 0
    assert [r["doc_id"] for r in out] == order
    for r in out:
        assert r["tokens"] == coding.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, a clashing column, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("position", F.lit(7)).withColumn("slot", F.lit(8))
    few = docs.where("doc_id < 20")
    odd = few.withColumn("text", F.lit(None).cast("string")).limit(2).unionByName(
        few.withColumn("text", F.lit("")).withColumn("source", F.lit(None).cast("string")).limit(2)
    )
    rows = few.unionByName(odd).unionByName(few.limit(3))
    rows.write.parquet(f"{tmp_path}/rows")
    for table in (spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/rows").limit(0)):
        count = table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= count
            if name != "bpe":
                assert out.columns == table.columns
            if name in ("personal_data", "mixing", "bpe"):
                assert out.count() == count
