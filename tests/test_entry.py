import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent
NAMES = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 100 and {*e.oracle_sql()} <= {*names}; print(sum(n.startswith('op') or n == 'pipeline' for n in names))"


@pytest.mark.parametrize("gone,left", [((), 14), (("corpus_pipeline.py",), 13), (("driftline/llm", "tests/llm"), 0), (("driftline/llm", "tests/llm", "corpus_pipeline.py"), 0)])
def test_entry_imports_without_optional_parts(tmp_path, gone, left):
    if any(not (REPO / x).exists() for x in ("driftline/llm", "corpus_pipeline.py")):
        pytest.skip("taken out already")
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for x in gone:
        shutil.rmtree(copy / x) if (copy / x).is_dir() else (copy / x).unlink(missing_ok=True)
    # the copy is the only place modules come from: a path that names the repository would put back what is gone
    alone = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONHOME")} | {"PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, env=alone, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == left, out.stderr
