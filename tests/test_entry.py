import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    got = entry.entry(spark)
    assert "micro_cer" in got.columns and got.count() == 5


def test_a_library_that_only_llm_needs_may_be_absent():
    code = "import sys\nsys.modules['ahocorasick'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q)\nassert set(e.oracle_sql()) <= set(q)"
    root = Path(entry.__file__).parent
    if not (root / "quillstone" / "llm").exists():
        return
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}).returncode == 0
