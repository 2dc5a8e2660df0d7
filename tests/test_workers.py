"""Executors need neither an installed package nor the repository as working folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entrypoint
from creditloom.testing import local_session
spark = local_session(2, 2)
for name in ("coarse_classing_report", "coarse_classing_apply"):
    assert entrypoint.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_classing_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", SCRIPT, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
