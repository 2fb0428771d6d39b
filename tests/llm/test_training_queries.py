import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rollweave.llm import oracles, packing, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted(({n: v for n, v in zip(names, r)} for r in found.fetchall()), key=repr)
    order = sorted(names)
    assert sorted(([r[c] for c in order] for r in df.collect()), key=repr) == sorted(([r[c] for c in order] for r in want), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_one_row_for_each_input_row(spark, name):
    table = "pages" if "main_text" in name else "documents"
    rows = queries.QUERIES[name](spark, SF).collect()
    key = "page_id" if table == "pages" else "doc_id"
    ids = [r[key] for r in rows]
    assert set(ids) == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert len(ids) == len(set(ids)) or "best_fit" in name


def test_registered():
    assert {n.split("_")[0] for n in entry.queries()} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()


def test_pipeline_against_its_stages(spark):
    """Each stage's decisions, taken by brute force from the one before."""
    docs = queries.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    text = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn(docs, queries.table(spark, SF, "labels"))
    left = {d: t for d, t in text.items() if model.score(t) < toxicity.THRESHOLD}
    groups = {}
    for d, t in left.items():
        groups.setdefault("".join(t.split(" ")).translate(dict.fromkeys(range(9, 14))), []).append(d)
    left = {d: left[d] for g in groups.values() for d in [min(g, key=lambda d: (-len(left[d]), d))]}
    ids = sorted(left)
    fps = [simhash.fingerprint(left[d]) for d in ids]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {ids[i]: left[ids[i]] for i in range(len(ids)) if find(i) == i}
    from test_training_operators import plain_contamination

    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    left = {d for d, found in plain_contamination(left.items(), items).items() if not found[3]}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left
    sizes = {r.doc_id: r.length for r in packing.tokenised_pieces(docs, queries.tokenizer_path(), queries.END_ID, capacity=1 << 30).collect()}
    for d in left:
        assert sum(r.length for r in rows if r.doc_id == d) == sizes[d]


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(50), SF)
        assert out.columns == docs.columns and out.count() > 0, name
