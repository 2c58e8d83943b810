"""Registered queries against their DuckDB SQL."""

import os
import random

import duckdb
import numpy as np
import pytest

from trendlake.llm import queries


def agree(spark, name, folder):
    """The rows of the SQL, once they equal the query's."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        files = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{files + '/*.parquet' if os.path.isdir(files) else files}'")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    assert sorted(con.sql(queries.ORACLES[name]).columns) == columns
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert len(theirs) > 0 and sorted(map(tuple, df.select(*columns).collect())) == sorted(theirs)
    return [dict(zip(columns, r, strict=True)) for r in theirs]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name, sf):
    agree(spark, name, f"/root/testdata/sf{sf}")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables in which vectors link, conversations need edits, and documents hold short and long items."""
    folder, rng, num = str(tmp_path_factory.mktemp("odd")), random.Random(5), np.random.default_rng(5)
    x = num.normal(size=(60, 8))
    x[20:] = x[num.integers(0, 20, 40)] + num.normal(size=(40, 8)) * 0.2
    vectors = [(k, [float(v) for v in x[k]], k % 2) for k in range(60)] + [(60, [0.0] * 8, 0), (61, None, 0), (62, [float(v) for v in x[0]], None), (63, [float("nan")] * 8, 1)]
    say = ["Hi.", "No", "Yes!\n", " \t", "", None, "Long " * 300 + "?", "\u2003", "é."]
    talk = [(rng.randrange(80), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(say)) for _ in range(400)]
    words = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(words[:25])), (2, "W3, ÉA zwölf"), (None, " ".join(words[20:32])), (3, None), (10, "w39")]
    docs = [(k, " ".join(words[a : a + rng.randrange(30)]) + rng.choice(["", " Éa w3 ÉA zwölf?", " W39"])) for k in range(120) for a in [rng.randrange(20)]] + [(120, None), (121, "")]
    for name, rows, schema in (
        ("embeddings", vectors, "vec_id long, embedding array<float>, label long"), ("conversations", talk, "conv_id long, turn long, role string, text string"),
        ("benchmark", items, "item_id long, text string"), ("documents", docs, "doc_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_odd_rows_match_oracle(spark, odd):
    assert sum(r["n_links"] > 0 for r in agree(spark, "op2_embedding_dedup", odd)) > 20
    assert {0, 1, 2, 3} <= {r["n_items"] for r in agree(spark, "op3_decontamination", odd)}
    assert set("KRD") <= set("".join(r["audit"] for r in agree(spark, "op13_conversation_repair", odd)))
