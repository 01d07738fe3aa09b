"""The text operators that SQL can express, against it, on the smallest tables and on rows of their own."""

import pytest

from skein.llm import oracle, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def rows_of(con, sql, names):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    return sorted((tuple(r[columns.index(c)] for c in names) for r in cursor.fetchall()), key=repr)


def hold(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    df = queries.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == rows_of(con, oracle.SQL[name], names) and got


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_query_equals_sql(spark, name):
    hold(spark, name, SF)


def test_links_equal_sql(spark, tmp_path):
    """Near copies and near vectors, which the smallest tables lack."""
    words = "the quick brown fox jumps over a lazy dog while twenty more words follow in the same short line of this plain text and so on".split()
    texts = [None, "", "one", "ONE", "two words", " ".join(words), " ".join(words[1:]), " ".join([*words, "more"]), " ".join(reversed(words)), " ".join(words).upper(), "É " + " ".join(words), "é " + " ".join(words)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [[1.0, 0.0, 0.1], [2.0, 0.0, 0.2], [1.0, 0.3, 0.0], [1.0, 0.6, 0.0], [0.0, 0.0, 1.0], None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [-1.0, 0.0, 0.0]]
    spark.createDataFrame([(i + 3, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    hold(spark, "op1_minhash_near_dedup", str(tmp_path))
    hold(spark, "op4_embedding_near_dedup", str(tmp_path))
