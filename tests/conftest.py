from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cloudsift.session import checkpoint_root, get_session  # noqa: E402

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="cloudsift-tests")
    checkpoint_root(s)  # the session's shared folder, or a local one when unset
    yield s


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
