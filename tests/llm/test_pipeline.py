"""The pipeline's stages one by one, and as a whole."""

from collections import Counter

import corpus_pipeline
from helpers import SF, document

from statewise.llm import toxicity
from statewise.llm.common import written


def test_stages_keep_clean_rows_and_columns(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        kept = Counter(r.doc_id for r in out.collect())
        assert kept == (Counter([None, 3, 7, 9, 11, 12]) if name == "simhash" else Counter(r.doc_id for r in odd.collect())), name
        assert stage(spark, none, SF).count() == 0


def test_whole_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = written(stage(spark, step, SF), name)
    assert Counter((r.doc_id, r.text, r.mix_slot) for r in out) == Counter((r.doc_id, r.text, r.mix_slot) for r in step.collect())
    ids = {r.doc_id for r in out}
    assert all(scores[i] < 0.5 for i in ids) and sorted(r.mix_slot for r in out) == list(range(len(out)))
    assert len({r.text for r in out}) == len(out) >= 0.6 * docs.count()
    assert all(r.n_chars == len(r.text) for r in out)


def test_planted_secrets_and_copies(spark, odd):
    key = "token = 'Zq8Lk2Vw9Xy3Rt5Mn7'"
    rows = [document(1, f"some words before {key} and after"), document(2, "one two three four five six seven"), document(3, "one two three four five six seven")]
    df = spark.createDataFrame(rows, odd.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["secrets"](spark, df, SF).where("doc_id = 1").first().text == "some words before [secret]' and after"
    assert sorted(r.doc_id for r in stages["simhash"](spark, df, SF).collect()) == [1, 2]


def test_near_duplicates_go_through_their_fingerprints(spark, odd, monkeypatch):
    """Documents of linked fingerprints are held against each other before any shingles meet."""
    from statewise.llm import simhash

    seen = []
    pairs = simhash.fingerprint_pairs

    def watched(nodes, *rest):
        found = written(pairs(nodes, *rest), "pairs")
        seen.append((nodes.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "fingerprint_pairs", watched)
    long = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([document(1, long + " one end"), document(2, long + " another end"), document(3, "some other words that stand alone")], odd.schema)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, df, SF).collect()) == [1, 3]
    assert seen == [(2, 1)]


def test_scans_hold_a_piece_of_a_batch(spark, odd):
    """Batches of any length go through in pieces, with every row once and in order."""
    import pyarrow as pa

    from statewise.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["x"])
    got = list(slices(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in got] == [1024, 1024, 452] and [x for b in got for x in b.column(0).to_pylist()] == list(range(2500))
    df = spark.createDataFrame([document(i, None if i % 7 == 0 else f"text {i} token = 'Zq8Lk2Vw9Xy3Rt5Mn7'") for i in range(3000)], odd.schema).coalesce(1)
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["secrets"](spark, df, SF).collect()}
    assert kept == {i: None if i % 7 == 0 else f"text {i} [secret]'" for i in range(3000)}
