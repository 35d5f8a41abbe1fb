"""The rest of the library without the language-model operators and the pipeline."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_rest_passes_alone(tmp_path):
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", str(ROOT), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "wirelake/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py"), str(copy / "tests/test_without_llm.py")], check=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, check=True, env=env, capture_output=True)
    # the rest of the tests run in this session anyway
    done = subprocess.run([sys.executable, "-m", "pytest", "tests/test_tokens.py", "tests/test_jobs.py", "-q", "-x"], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]
