"""Every catalog query against its SQL on the smallest tables."""

import pytest

from pointloom import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry_without_document_operators(tmp_path):
    """The entry module imports and answers when the document operators are gone."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(queries.__file__)))
    shutil.copytree(f"{top}/pointloom", tmp_path / "pointloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pair_shells' in q and not any(k.startswith('op') for k in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
