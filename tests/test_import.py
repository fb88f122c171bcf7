import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_needs_no_session():
    """The driver may import the entry before it makes a session."""
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 200)"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-1:] == ["True"], out.stderr[-500:]
