import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_registry():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_core_stands_without_the_llm_subpackage():
    code = "import sys; sys.modules['kgloom.llm'] = None\ntry:\n    import __spark_entry__ as e\n    print(len(e.queries()))\nexcept ModuleNotFoundError as x:\n    print('missing', x.name)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert int(out) > 90
    for p in (ROOT / "kgloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "kgloom.llm" not in p.read_text(), p


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["table_name", "key_value"]
