from __future__ import annotations

import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestack.session import build_session, ship

    s = build_session("tests", 8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    yield s
    s.stop()


def _write(folder: str, change) -> str:
    for name in os.listdir(SMALL):
        t = pq.read_table(f"{SMALL}/{name}")
        pq.write_table(change(name[:-8], t), f"{folder}/{name}")
    return folder


@pytest.fixture(scope="session")
def empty_tables(tmp_path_factory) -> str:
    """All tables without rows."""
    return _write(str(tmp_path_factory.mktemp("empty")), lambda n, t: t.slice(0, 0))


@pytest.fixture(scope="session")
def rough_tables(tmp_path_factory) -> str:
    """Some rows of each table, two rows stored twice, a row of nulls, a row whose texts are empty, and
    extra columns with names that operators might use themselves."""

    def rough(name: str, t: pa.Table) -> pa.Table:
        t = t.slice(0, 60)
        nulls = pa.table({f.name: pa.nulls(1, f.type) for f in t.schema})
        blank = pa.table({f.name: pa.array([""], pa.string()) if pa.types.is_string(f.type) else t.column(f.name).slice(0, 1).combine_chunks() for f in t.schema})
        out = pa.concat_tables([t, t.slice(0, 2), nulls.cast(t.schema), blank.cast(t.schema)])
        for extra in ("h", "id_", "line", "n", "site", "rank", "block", "state", "key", "score"):
            if extra not in out.column_names:
                out = out.append_column(extra, pa.array(["x"] * out.num_rows))
        return out

    return _write(str(tmp_path_factory.mktemp("rough")), rough)
