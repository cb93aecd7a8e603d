from collections import Counter

import pytest
from brute import decontaminated, jaccard_components

import corpus_pipeline
from logfold.llm import common, curriculum, toxicity, training_order


def test_stages_on_their_own_input(spark, sf_dir, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "curriculum_mixing", "training_order"]
    docs = common.table(spark, sf_dir, "documents")
    columns, held = docs.columns, {}

    def step(name):
        nonlocal docs
        stages[name](spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] if "text" in docs.columns else docs.collect()
        return held[name]

    whole = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, common.table(spark, sf_dir, "labels")).collect()}
    civil = step("toxicity")
    assert Counter(civil) == Counter(r for r in whole if not judged[r[0]])
    assert docs.columns == columns

    unlike = step("ngram_jaccard_join")
    groups = {d: c for d, _, c in jaccard_components([r[:2] for r in civil], 5, 80)}
    assert sorted(r[0] for r in unlike) == sorted(set(groups.values()))
    assert docs.columns == columns

    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    clean = step("benchmark_decontamination")
    bad = {r[0] for r in decontaminated([r[:2] for r in unlike], items) if r[5]}
    assert bad and sorted(r[0] for r in clean) == sorted(r[0] for r in unlike if r[0] not in bad)
    assert docs.columns == columns

    plan = {r["doc_id"]: r["copies"] for r in curriculum.plan(docs).collect()}
    mixed = step("curriculum_mixing")
    assert Counter(r[0] for r in mixed) == Counter({d: c for d, c in plan.items() if c})
    assert docs.columns == columns

    order = [r[0] for r in docs.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    index = step("training_order")
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    assert all(r["slot"] // corpus_pipeline.BLOCK == r["number"] // corpus_pipeline.BLOCK for r in index)
    assert [r["doc_id"] for r in sorted(index, key=lambda r: r["number"]) if not r["part"]] == order
    tokens = Counter()
    for r in index:
        tokens[r["doc_id"]] += r["n_tokens"]
    texts = {r[0]: r[1] for r in mixed}
    assert tokens == Counter({d: plan[d] * len(training_order.tokens(texts[d])) for d in texts})


def test_run_applies_every_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:5] == ["doc_id", "part", "number", "slot", "shard"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, make_docs, sf_dir):
    docs = make_docs([(1, "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "empty")
    assert docs.count() == 0


def test_nulls_repeats_clashing_names_and_others_folders(spark, make_docs, sf_dir):
    other = common.materialise(spark.range(3), "other")
    rows = [(1, "some words of a text that stays here " * 9, "a"), (1, "some words of a text that stays here " * 9, "a"), (None, None, None), (2, "", "b"), (None, "one more text with words of its own", None)]
    docs = make_docs(rows, extra=["__row", "uid", "slot", "text_crc32", "copies", "positions"])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "odd")
        if name != "training_order":
            assert docs.columns == columns
        if name in ("ngram_jaccard_join", "benchmark_decontamination"):
            assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in docs.collect()) == [(0, 0), (0, 35), (1, 333), (2, 0)]
    assert docs.count() > 0 and other.count() == 3


def test_a_failed_run_leaves_no_work_folders(spark):
    app = spark.sparkContext.applicationId
    before = list(common._made.get(app, []))
    with pytest.raises(RuntimeError), common.scratch(spark):
        path = common.new_dir(spark, "gone")
        spark.range(1).write.parquet(path)
        raise RuntimeError
    assert common._made[app] == before and not common.exists(spark, path)
