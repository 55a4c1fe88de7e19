from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from threatsift.llm import jaccard, mixing, pii, quality
from threatsift.llm.common import read_table, staged
from tests.llm.helpers import SF, hard_docs, labels_of, no_docs
from tests.llm.test_graph_and_joins import expected_components
from tests.llm.test_packing import filled


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard_join", "pii", "source_mixing", "best_fit_packing"]
    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")}


def test_every_stage_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    columns, outputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(docs := staged(stage(spark, docs, SF), f"test-{name}"))
    good, single, marked, mixed, packed = outputs
    assert all(o.columns == columns for o in outputs[:-1])
    first = read_table(spark, SF, "documents")

    accepted = {r["doc_id"] for r in quality.score_quality(first, read_table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted

    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in expected_components(texts).values()})

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in marked.collect():
        spans = [(k, s, e) for k, found in pii.base_spans(before[r["doc_id"]]).items() for s, e in found]
        assert r["n_chars"] == len(r["text"])
        assert not any(pii.base_spans(r["text"]).values())
        assert (r["text"] == before[r["doc_id"]]) == (not spans) or spans == []

    sizes, taken = Counter(), Counter()
    for r in marked.collect():
        sizes[r["source"]] += len(r["text"].split())
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(before)
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    largest = {r["source"]: r["m"] for r in marked.groupBy("source").agg(F.max(mixing.word_count(F.col("text"))).alias("m")).collect()}
    targets = {r["source"]: r["target"] for r in mixing.source_targets(
        marked.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]

    rows = packed.collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies
    filled([(r["sequence_id"], r["offset"], r["length"]) for r in rows])


@pytest.mark.parametrize("make", [hard_docs, no_docs])
def test_stages_on_hard_tables(spark, make, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda *_: labels_of(spark, []))
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == docs.columns
        rows = out.count()
        assert make is hard_docs or rows == 0
        if name != "quality_classifier":            # without labels the classifier accepts nothing
            docs = staged(out, "test") if name != "best_fit_packing" else docs


def test_near_duplicate_stage_keeps_one_row_of_repeated_ids(spark):
    kept = jaccard.keep_one(hard_docs(spark)).where("doc_id = 6")
    assert kept.count() == 1


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(50)]
    near = [*words[:25], "other", *words[26:]]        # 41 of 51 shingles of five words, 43 of 51 of four
    far = [*words[:15], "x", *words[16:30], "y", *words[31:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3]
