"""Every registered query with SQL against DuckDB."""
import glob
import os

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_oracle(spark, duck, name):
    df, out = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE[name])
    columns = sorted(c[0] for c in out.description)
    assert sorted(df.columns) == columns
    places = [[c[0] for c in out.description].index(c) for c in columns]
    want = sorted(repr([r[i] for i in places]) for r in out.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_curriculum_has_a_place_for_every_document(spark):
    docs, got = spark.read.parquet(f"{SF}/documents.parquet").count(), registry.QUERIES["curriculum_order"](spark, SF).collect()
    assert docs > 100 and sorted(r["place"] for r in got) == list(range(1, docs + 1))
    from textloom.operators import splits

    rows = [(k, n) for k, n in enumerate([3, 3, None, 1, 3, 1, 2, None, 3])]
    want = {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])), 1)}
    placed = splits.curriculum(spark.createDataFrame(rows, "id long, n long"), "n", "id", cell=2).collect()
    assert {r["id"]: r["place"] for r in placed} == want


def test_samples_and_exclusion_look_at_every_row(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["level"], r["text"]) for r in registry.QUERIES["samples_by_level"](spark, SF).collect()}
    assert got == {i: ("A1 A2 B1".split()[i % 6], t) for i, t in docs.items() if i % 6 < 3} and max(got) >= 60
    assert {r["id"] % 2 for r in registry.QUERIES["dpo_exclude_eval"](spark, SF).collect()} == {0, 1}


def test_paragraphs_of_a_source_are_split_text_by_text(spark, tmp_path):
    """A text without value hides no other of its source, and no source is gathered into one row."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["a\n \nb  c\n", None, "\n\nb c\n\t\n\nd\ne\n", " \n ", "", "b c", "\n\n x \n\n\n y", "a"]
    columns = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": ["s", "s", "s", "s", "s", "t", None, None]}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got, want = registry.QUERIES["paragraph_split"](spark, str(tmp_path)), con.execute(registry.ORACLE["paragraph_split"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) == 7
    assert "collect_list" not in got._jdf.queryExecution().toString()
