import hashlib

import public_tokenizers
import pytest
from awkward import documents, empty
from test_simhash_pivots import classes, slow_fingerprint
from test_suffix_dedup import brute as brute_repeats
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """What each stage was given and what it returned, on the smallest tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet").cache(), []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, FOLDER).cache()
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return out


def test_columns_and_registration(results):
    assert [n for n, *_ in results] == [n for n, _ in pipeline.STAGES]
    for _, given, made in results[:-1]:
        assert made and made[0].asDict().keys() == given[0].asDict().keys()
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names


def test_quality_stage_keeps_good_documents(spark, results):
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    _, given, made = results[0]
    kept = {r.doc_id for r in made}
    good, bad = ({r.doc_id for r in given if marked.get(r.doc_id) == q} for q in (1, 0))
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.1 * len(bad) + 1


def test_near_duplicate_stage_against_all_pairs(results):
    _, given, made = results[1]
    given = sorted(given, key=lambda r: r.doc_id)
    of = classes([slow_fingerprint(r.text) for r in given], 3)
    want = [r for k, r in enumerate(given) if of[k] == k]
    assert sorted(made, key=lambda r: r.doc_id) == want


def test_repeats_stage_against_all_windows(results):
    _, given, made = results[2]
    want = {i: kept.decode("utf-8", "ignore") for i, kept, _ in brute_repeats([(r.doc_id, r.text) for r in given])}
    assert {r.doc_id: r.text for r in made} == want
    assert all(r.n_chars == len(r.text) for r in made)
    assert {r.doc_id: (r.lang, r.source) for r in made} == {r.doc_id: (r.lang, r.source) for r in given}


def test_contaminated_documents_go_and_no_others(spark, results):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    _, given, made = results[3]
    kept = {r.doc_id for r in made}
    holds = {r.doc_id for r in given if any(t in r.text for t in items)}
    assert not holds & kept
    assert all(r in made for r in given if r.doc_id in kept) and len(kept) >= len(given) - len(holds) - 2


def test_tokens_of_the_last_stage(results):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, given, made = results[4]
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in given}
    assert {r.doc_id: list(r.ids) for r in made} == want and all(r.n_tokens == len(r.ids) for r in made)
    assert {r.doc_id: r.decoded_sha256 for r in made} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in given}


def test_run_is_the_stages_in_order(spark, results):
    got = sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, FOLDER).collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in results[-1][2])


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_and_empty_tables(spark, stage):
    function = pipeline.STAGES[stage][1]
    docs = documents(spark).withColumnRenamed("n", "n_chars")
    made = function(spark, docs, FOLDER)
    if stage < 4:
        assert made.columns == docs.columns
        of = {r.doc_id: r for r in docs.collect()}
        same = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
        assert all([r[c] for c in same] == [of[r.doc_id][c] for c in same] for r in made.collect())
    assert made.count() > 0
    assert function(spark, empty(spark).withColumnRenamed("n", "n_chars"), FOLDER).count() == 0
