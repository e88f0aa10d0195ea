from collections import Counter

import __spark_entry__ as contract
import corpus_pipeline
from discern.llm.common import saved
from discern.llm.queries import queries


def test_every_query_is_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries()) <= set(names)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = sorted(docs.dtypes)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, data))
        assert sorted(docs.dtypes) == columns, name
        counts.append(docs.count())
        assert 0 < counts[-1] <= counts[-2]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    by = Counter()
    for r in mixed:
        by[r["source"]] += r["n_words"]
    again = Counter()
    for r in corpus_pipeline.run(spark, data).select("source", "n_words").collect():
        again[r["source"]] += r["n_words"]
    assert by == again and len(by) > 1
    words = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert abs(sum(by.values()) - words) <= len(by)


def test_empty(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, hit int, h int, lines string, t string, Score double"
EN, DE = "the house and the river and a tree", "das Haus und der Fluss und ein Baum"


def rows(*docs):
    return [(d, t, x, s, None, "r", 1, 2, 3, "l", "t", 0.5) for d, t, x, s in docs]


def stage(name, spark, docs, data):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows(*docs), SCHEMA), data)
    got = out.collect()
    if name != "mixing":
        assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and all(r["row"] == "r" and r["Score"] == 0.5 for r in got)
    return got


def test_language_stage_uses_its_prediction(spark, data):
    docs = [(i, f"{EN} {i}", "en", "s") for i in range(30)] + [(100 + i, f"{DE} {i}", "de", "s") for i in range(30)]
    docs += [(200, DE, None, None), (200, DE, None, None), (None, EN, "de", "s"), (201, None, "en", "s"), (202, "12 !", "en", "s"), (203, "", None, "s")]
    got = Counter((r["doc_id"], r["lang"]) for r in stage("language_id", spark, docs, data))
    assert got == Counter([(i, "en") for i in range(30)] + [(100 + i, "de") for i in range(30)] + [(200, "de")] * 2 + [(None, "en")])
    untaught = [(i, EN, None, "s") for i in range(5)] + [(9, None, None, None)]
    assert len(stage("language_id", spark, untaught, data)) == 6


def test_line_stage(spark, data):
    line = "this line is long enough to be taken for one"
    got = stage("line_dedup", spark, [(1, line, "en", "s"), (1, "own\n" + line, None, "s"), (None, line, "en", None), (2, None, "en", "s"), (3, " \n", "en", "s"), (4, "é", "en", "s"), (4, "é", "en", "s")], data)
    assert sum(line in r["text"] for r in got) == 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter(r["doc_id"] for r in got if line not in r["text"]) in (Counter({1: 1, 4: 2}), Counter({4: 2}))


def test_document_stage(spark, data):
    got = stage("near_dedup", spark, [(2, EN, "en", "s"), (1, EN, "de", "s"), (1, EN, "de", "s"), (None, EN, None, None), (1, DE, "de", "s"), (None, None, None, None), (7, "", "en", "s")], data)
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, DE), (1, EN), (7, "")]


def test_decontamination_stage(spark, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    got = stage("decontamination", spark, [(1, item, "en", "s"), (1, EN, "en", "s"), (None, item, "en", "s"), (None, EN, "en", "s"), (None, EN, "en", "s"), (2, None, None, None), (3, "", "en", "s")], data)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("1", EN), ("None", EN), ("None", EN), ("2", ""), ("3", "")])


def test_mixing_stage(spark, data):
    got = stage("mixing", spark, [(1, EN, "en", "a"), (1, EN, "en", "a"), (None, DE, None, None), (2, None, "en", "b"), (3, " ", "en", "a")], data)
    words = len(EN.split())
    assert sum(r["n_words"] for r in got) == 2 * words + len(DE.split()) and {r["source"] for r in got} == {"a", None}


def test_tables_go_once_the_next_is_written(spark, data, tmp_path, monkeypatch):
    from discern.llm import common

    paths = []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: paths.append(common.written(df)) or paths[-1])
    corpus_pipeline.run(spark, data)
    assert [spark.read.parquet(p).count() > 0 for _, p in paths] == [False] * 3 + [True]


def test_python_tasks_get_small_batches(spark, data):
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame(rows((1, EN, "en", "s")), SCHEMA)
    for own, want in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (10, 10)):
        spark.conf.set(name, str(own))
        corpus_pipeline._batched(spark)
        assert int(spark.conf.get(name)) == want
    spark.conf.unset(name)
    corpus_pipeline.mix_sources(spark, docs, data)
    assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
