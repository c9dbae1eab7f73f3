"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from wavestack.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    out = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    out.sparkContext.setLogLevel("ERROR")
    return out


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def rows(df) -> list[tuple]:
    """Rows as comparable tuples, columns by name, sorted."""
    names = sorted(df.columns)

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5) + 0.0
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, int):
            return v
        return str(v)

    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    """The same of DuckDB's result."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(n) for n in sorted(names)]

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5) + 0.0
        if isinstance(v, bool) or v is None or isinstance(v, int):
            return v
        return str(v)

    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
