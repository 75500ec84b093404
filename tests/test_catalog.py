import pytest

from helixframe import catalog

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_core_does_not_need_the_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['helixframe.llm'] = None\nimport __spark_entry__ as e\nassert 'alt_type_counts' in e.queries(); assert not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
