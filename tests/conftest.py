import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathgram.plans.fixtures import SPEC, customer_indicators  # noqa: E402
from pathgram.session import build_session, materialise  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def fx(spark):
    return materialise(customer_indicators(spark, SF), "fx")


@pytest.fixture(scope="session")
def rows(fx):
    return fx.select("case_id", *SPEC.indicators).toPandas().dropna().sort_values("case_id").reset_index(drop=True)
