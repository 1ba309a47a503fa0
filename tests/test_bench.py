"""The bench from a folder where the package can't be imported by chance."""

import json
import os
import subprocess
import sys

from conftest import SF_DIR

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_ships_the_package_to_python_workers(tmp_path):
    settings = {"BENCH_QUERIES": "tensor_headers", "BENCH_SF_DIR": SF_DIR, "BENCH_CPUS": "2", "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, f"{REPO}/bench.py"], cwd=tmp_path, env=os.environ | settings, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    result = json.loads(done.stdout.splitlines()[-1])
    assert result["queries"].keys() == {"tensor_headers"} and result["sf"] == "0.001"
