"""The corpus pipeline on the smallest tables, stage by stage, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from earshot.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages(stages):
    names = ["input", *(n for n, _ in corpus_pipeline.STAGES)]
    for name in names[:-1]:
        assert stages[name].columns == corpus_pipeline.COLUMNS
        assert stages[name].where("n_chars <> length(text)").count() == 0
    ids = [{r.doc_id for r in stages[n].select("doc_id").collect()} for n in names]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert ids[2] == ids[3] == ids[4] == ids[5]


def test_near_copies_go_and_one_stays(spark, stages):
    def sets(name):
        return {
            r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))}
            for r in stages[name].collect()
        }

    before, after = sets("toxicity"), sets("near_duplicates")
    alike = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    kept = list(after.values())
    assert not any(alike(a, b) for i, a in enumerate(kept) for b in kept[:i])
    for i in before.keys() - after.keys():
        assert any(alike(before[i], s) for j, s in before.items() if j != i)


def test_personal_data_is_masked(stages):
    text = " ".join(r.text for r in stages["pii"].collect())
    assert "@mail" not in text


def test_empty_and_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (1, "", "en", "s", 0), (2, "word " * 30_000, "en", "s", 150_000), (2, "word " * 30_000, "en", "s", 150_000)]
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == bool(data)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg({"offset": "max"}).first()[0] < 1024


def test_registered():
    registry.load_all()
    names = {n.split("_")[0] for n in registry.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(registry.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_path_templates", "op3_hyperminhash", "op5_sign_hashing", "op7_uniform_threshold", "op11_merkle_manifest", "op12_line_dedup", "op13_spelling_variants"])
def test_sql(spark, name):
    registry.load_all()
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    rows = lambda x, columns: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in x)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(want.fetchall(), names)
