import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from retenta.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app="retenta-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    # the cluster names the checkpoint folder; tests only fill it in when unset
    ensure_checkpoint_dir(s, fallback=str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()
