import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from leafvoice.session import local_session

    session = local_session(cores=8, app="leafvoice-tests", checkpoint_dir=tempfile.mkdtemp(prefix="run-"))
    # Small inputs: few partitions, but more than one.
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture
def tmp(request):
    return tempfile.mkdtemp(prefix="run-")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
