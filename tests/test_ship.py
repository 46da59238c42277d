"""Python workers find the package wherever the session was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from ledgerlark.session import build_session
spark = build_session("ship", "local[4]", 4)
for name in ("m9_isolation_forest_fit", "t5_cooldown_stream"):
    print("ROWS", name, e.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("ROWS") == 2, done.stderr[-2000:]
