import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(float(v[i]), 6) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_the_entry_module_guards_imports():
    top = Path(entry.__file__).parent
    for path in top.rglob("*.py"):
        if path.name != "__spark_entry__.py" and "tests" not in path.parts:
            text = path.read_text()
            assert "except ImportError" not in text and "ModuleNotFoundError" not in text, path
            if "llm" not in path.parts and path.name != "corpus_pipeline.py":
                assert "loamline.llm" not in text, path


def test_entry_works_without_the_optional_part(monkeypatch):
    real = entry.importlib.import_module

    def missing(name):
        if name.startswith("loamline.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert "coupling" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

    def broken(name):
        raise ModuleNotFoundError(name="numpy")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
