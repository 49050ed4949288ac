import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from railtide.session import local_session

    s = local_session(4, 4, "railtide-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def folder():
    for name in ("0.001", "0.01"):
        p = Path(f"/root/testdata/sf{name}")
        if p.exists():
            return str(p)
    pytest.skip("no test tables here")
