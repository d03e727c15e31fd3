from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings mdr_samples rr_samples wiki_docs index_paras iter_queries evidence_sents dataset_catalogue"
).split()


@pytest.fixture(scope="session")
def spark():
    from tessel.session import local_session

    return local_session(cores=8, partitions=4)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con
