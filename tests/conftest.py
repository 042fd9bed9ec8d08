import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def bank(spark, tmp_path_factory):
    """A small generated bank, stored so that role sessions can read it."""
    from veilframe.sources import synthetic

    root = tmp_path_factory.mktemp("bank")
    for name, df in synthetic.bank(spark, 60, 12).items():
        df.write.parquet(f"{root}/{name}")
    return {
        name: (lambda s, p=f"{root}/{name}": s.read.parquet(p))
        for name in ("customers", "accounts", "transactions", "advisors")
    }
