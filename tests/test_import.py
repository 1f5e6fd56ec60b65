"""The contract functions work before any session exists."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path


def test_contract_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
