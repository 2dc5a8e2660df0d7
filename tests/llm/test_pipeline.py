"""The pipeline's stages on a small fixture, and all queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, rows_of
from creditloom.llm import queries


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if name in queries.SQL:
        cur = duck.execute(queries.SQL[name])
        assert rows_of(df.columns, got) == rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        table = "pages" if name.startswith(("op4", "op7", "op9")) else "embeddings" if name.startswith("op11") else "documents"
        each = 32 if table == "embeddings" else 1  # a row per component
        assert len(got) == each * spark.read.parquet(f"{small}/{table}.parquet").count()


def chained(spark, docs, tmp_path):
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs)
    return results


def unique(k, n=30):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_stages_take_effect(spark, docs_of, tmp_path):
    copy = unique(7)
    rows = [(k, f"{unique(k)}\n{unique(k + 1000)}", f"s{k % 3}") for k in range(40)]
    near = unique(500, 200).split()
    rows += [(500, " ".join(near)), (501, " ".join([*near[:100], "changed", *near[101:]]))]
    rows += [(600, copy + "\nand one more line with words of its own in it, ten words or more"), (601, copy), (700, None), (701, "too short"), (702, "a b c d e " * 20), (None, unique(900)), (None, unique(901)), (3, rows[3][1])]
    docs_of(rows).write.parquet(str(tmp_path / "in"))
    quality, lines, near_docs, mixed, tokens = chained(spark, spark.read.parquet(str(tmp_path / "in")), tmp_path)
    assert all(r.columns == corpus_pipeline.COLUMNS for r in (quality, lines, near_docs, mixed))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(quality) == {*range(40), 500, 501, 600, 601, None} and quality.count() == 47
    text = {r.doc_id: r.text for r in lines.collect()}
    assert 601 not in text and text[600].startswith("and one more") and text[0] == rows[0][1] and lines.count() == 45
    assert ids(near_docs) == {*range(40), 500, 600, None} and near_docs.count() == 44
    sizes = {r.source: r.n for r in mixed.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    assert set(sizes) <= {"s", "s0", "s1", "s2"} and tokens.count() == mixed.count()
    assert all(r.n_tokens * 4 == len(r.ids) for r in tokens.collect())


def test_near_stage_matches_brute_force(spark, docs_of, tmp_path):
    base = [unique(k, 200).split() for k in range(12)]
    texts = [" ".join(b) for b in base]
    # One changed word per step of 200 / k: between the settings of the stage and of op5's query.
    texts += [" ".join(f"c{k}y{j}" if j % (200 // (k + 1)) == 50 // (k + 1) else w for j, w in enumerate(b)) for k, b in enumerate(base)]
    sets = lambda words: [{tuple(w[j : j + words]) for j in range(len(w) - words + 1)} for w in map(str.split, texts)]

    def reached(words, percent):
        s = sets(words)
        return {k for k in range(12) if 100 * len(s[k] & s[12 + k]) >= percent * len(s[k] | s[12 + k])}

    assert 0 < len(reached(3, 90)) < len(reached(5, 80)) < 12
    docs_of(list(enumerate(texts))).write.parquet(str(tmp_path / "in"))
    left = corpus_pipeline.near_stage(spark, spark.read.parquet(str(tmp_path / "in")), "").collect()
    assert {r.doc_id for r in left} == {*range(24)} - {12 + k for k in reached(5, 80)}


def test_empty_tables_pass(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "in"))
    assert [d.count() for d in chained(spark, spark.read.parquet(str(tmp_path / "in")), tmp_path)] == [0] * 5


def test_run_reads_documents(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_row_keys_do_not_depend_on_the_join(spark, docs_of, tmp_path, monkeypatch):
    docs_of([(k % 7, unique(k, 5)) for k in range(60)]).repartition(6).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    keys = lambda: sorted((r["_row"], r["doc_id"], r["text"]) for r in corpus_pipeline.placed(docs).collect())
    small = keys()
    join = corpus_pipeline.lookup_join
    monkeypatch.setattr(corpus_pipeline, "lookup_join", lambda *a, **k: join(*a, **k, limit=0))
    assert keys() == small and len({r[0] for r in small}) == 60
