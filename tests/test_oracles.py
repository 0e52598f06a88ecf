"""Every query against its SQL in DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import verdikt.plans.lifecycle  # noqa: F401
import verdikt.plans.simulations  # noqa: F401
from verdikt.plans.queries import ORACLES, QUERIES
from verdikt.plans.simulations import STUDIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(map(repr, map(tuple, want)))


def test_what_has_no_sql():
    """Simulations of drawn numbers, which test_studies runs."""
    assert set(QUERIES) - set(ORACLES) == set(STUDIES) | {"cusum_calibration", "psi_calibration", "disagreement_calibration"}


def test_entry_without_the_optional_part(tmp_path):
    """An import that fails inside the optional subpackage leaves the other queries alone."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'cusum' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
