import random

import duckdb
import pytest

import check_oracle
import corpus_pipeline as c
from netloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import sentence

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df, cur = QUERIES[name](spark, FOLDER), con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert check_oracle.rows_of(df.collect(), df.columns) == check_oracle.rows_of(cur.fetchall(), names)


def test_stages(spark, make_docs, tmp_path):
    rng = random.Random(6)
    item, near = sentence(rng, 30), sentence(rng, 200)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(i, sentence(rng, 60)) for i in range(30)]
    texts += [(40, near), (41, near + " more"), (42, near), (43, f"start {item} end {texts[0][1]} {texts[1][1]}"), (44, None), (45, "12 34"), (46, item), (47, "write to a.b@example.com now"), (47, "write to a.b@example.com now")]
    docs = make_docs(texts)
    out = {}
    for name, stage in c.STAGES:
        docs = c.cut(stage(spark, docs, str(tmp_path)), name)
        out[name] = sorted((r.doc_id, r.text) for r in docs.collect())
        assert name == "mix" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i, _ in texts[:30]}
    assert {i for i, _ in out["language"]} == {i for i, _ in texts} - {44, 45}
    assert [i for i, _ in out["near_duplicates"]] == [*sorted(clean), 40, 43, 46, 47]
    assert dict(out["benchmark"])[43] .startswith("start  end w") and 46 not in dict(out["benchmark"]) and all(dict(out["benchmark"])[i] == dict(texts)[i] for i in clean)
    assert dict(out["personal_data"])[47] == "write to [EMAIL] now" and all(dict(out["personal_data"])[i] == dict(texts)[i] for i in clean)
    assert {i for i, _ in out["mix"]} <= {*clean, 40, 43, 47}


def test_null_ids_and_ids_with_several_texts(spark, make_docs):
    rng = random.Random(9)
    near, other, third = (sentence(rng, 200) for _ in range(3))
    alone = [(None, sentence(rng, 90)) for _ in range(5)]
    # copies among null ids; of a smaller id, where another text of the id stays; of two rows of one id
    texts = alone + [(None, near), (None, near + " more"), (None, near), (3, other), (7, other + " more"), (7, sentence(rng, 120)), (8, third), (8, third + " more"), (None, other)]
    rows = [(r.doc_id, r.text) for r in c.near_duplicates(spark, make_docs(texts, source=lambda i: "s").repartition(3), "").collect()]
    assert len(rows) == len(set(rows)) == 9 and set(rows) <= set(texts)
    assert set(alone) | {(3, other), texts[10]} <= set(rows)
    assert sum(t.startswith(near) for _, t in rows) == 1 and [i for i, t in rows if t.startswith(third)] == [8]


def test_mix_keeps_every_row_it_takes(spark, make_docs):
    rng = random.Random(10)
    texts = [(None, sentence(rng, 50 + i)) for i in range(6)] + [(1, sentence(rng, 300)), (1, sentence(rng, 40)), (1, "same text"), (1, "same text"), (2, "")]
    docs = make_docs(texts, source=lambda i: "s")
    plan = [r for r in c.mixing.mix(docs).collect() if r.taken > 0]
    got = c.mix(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in plan) > 3 and len(got) == len(plan)
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(r.doc_id), r["size"], r.taken) for r in plan)
    assert all(r["size"] == len(r.text.split()) and r.taken <= 2 * r["size"] for r in got)


def test_run_on_a_table(spark):
    rows = c.run(spark, FOLDER)
    assert {"doc_id", "text", "taken"} <= set(rows.columns) and 100 < rows.count() <= 200


def test_empty_tables(spark, make_docs, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([]).limit(0)
    for name, stage in c.STAGES:
        docs = c.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_columns_named_like_those_of_the_stages(spark, make_docs, tmp_path):
    rng = random.Random(12)
    spark.createDataFrame([(1, sentence(rng, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["score", "lang_pred", "LANG_PRED_own", "row_number_in_stage", "_found", "node", "th", "comp", "block", "h", "shard", "sid"]
    docs = make_docs([(i, sentence(rng, 60)) for i in range(20)]).selectExpr("*", *(f"concat('{n}-', doc_id) AS `{n}`" for n in names))
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        docs = c.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        assert all(r[n] == f"{n}-{r.doc_id}" for r in docs.collect() for n in names)
    mixed = c.mix(spark, docs.selectExpr("*", "'x' AS Size", "'y' AS taken"), "")
    assert mixed.columns == [*columns, "size", "target", "taken"]
    rows = mixed.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names) and all(r["size"] == 60 and r.taken > 0 for r in rows)
