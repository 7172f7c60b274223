from pathlib import Path

import edge

import corpus_pipeline
from corvane.llm import decontaminate, jaccard, queries, sql
from corvane.llm.queries import QUERIES


def test_each_stage_works_on_what_its_predecessor_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == names, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] >= counts[4] > 0
    assert decontaminate.report(docs, bench).where("contaminated").count() == 0
    last = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_groups_keep_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = jaccard.representatives(docs)
    joined = jaccard.join(docs).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in joined})


def test_stages_handle_odd_tables(spark, sf_dir):
    for table in (edge.documents(spark), edge.none(spark)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= table.count()


def test_stages_on_odd_rows_give_defined_values(spark, sf_dir):
    docs = edge.documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    single = stages["jaccard_join"](spark, docs, sf_dir)
    assert single.columns == docs.columns
    ids = sorted(r["doc_id"] for r in single.where("doc_id is not null").collect())
    assert ids == [0, 1, 2, 3, 4, 8, 9, 10, 11] and single.where("doc_id is null").count() == 2
    clean = stages["decontamination"](spark, docs, sf_dir)
    assert edge.collected(clean) == edge.collected(docs)  # nothing of the benchmark is in these rows
    encoded = edge.by_id(stages["sentencepiece"](spark, docs, sf_dir))
    assert [encoded[k]["n_tokens"] for k in (0, 1)] == [0, 0]


def test_run_leaves_only_its_last_table(spark, tmp_path, sf_dir):
    from corvane.operators import stage

    before = set(Path(stage.folder(spark).removeprefix("file:")).iterdir())
    made = corpus_pipeline.run(spark, sf_dir)
    names = {p.name.rsplit("-", 1)[0] for p in set(Path(stage.folder(spark).removeprefix("file:")).iterdir()) - before}
    assert made.count() > 0 and names & {n for n, _ in corpus_pipeline.STAGES} == {"sentencepiece"}


def test_registered():
    import __spark_entry__ as entry

    assert len(QUERIES) == 10 and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(sql.ORACLE_SQL) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "jaccard_join", "decontamination", "sentencepiece"]


def test_sql(spark, sf_dir):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent.parent))
    from compare import duck_rows, spark_rows

    for name, text in sql.ORACLE_SQL.items():
        assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(text, sf_dir)
