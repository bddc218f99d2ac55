import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures  # noqa: E402


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    return fixtures.write(spark, tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return fixtures.write(spark, tmp_path_factory.mktemp("empty"), empty=True)
