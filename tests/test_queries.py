"""Every registered query of the library against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stripewise.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, tiny, name):
    df = catalogue.QUERIES[name](spark, tiny)
    rows = df.collect()
    assert rows or name == "zone_map_prune"  # the smallest table has no such value
    if name in catalogue.ORACLES:
        said = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in said.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        expected = sorted(repr([plain(r[k]) for k in order]) for r in said.fetchall())
        assert sorted(repr([plain(x) for x in r]) for r in rows) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_imports_without_the_optional_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/stripewise", tmp_path / "stripewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    assert int(out.stdout) == len(catalogue.QUERIES)


def test_the_rest_works_without_what_the_optional_part_needs(tmp_path):
    import subprocess
    import sys

    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {root!r}]; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(catalogue.QUERIES)


def test_the_package_ships_to_executors(spark):
    import zipfile

    from stripewise.session import ship

    ship(spark)
    name = next(str(x) for x in spark.sparkContext._python_includes if str(x).endswith("stripewise.zip"))
    from pyspark import SparkFiles

    names = zipfile.ZipFile(SparkFiles.get(name)).namelist()
    assert "stripewise/operators/runs.py" in names and not any(n.endswith(".pyc") for n in names)
