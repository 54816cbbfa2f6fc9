"""The driver contract imports from any working directory and is consistent."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract_from_another_directory(tmp_path):
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "q, s = E.queries(), E.oracle_sql(); "
            "assert set(s) <= set(q) and len(q) >= 50 and all(callable(f) for f in q.values()); "
            "assert all(isinstance(v, str) and v.strip() for v in s.values()); print(len(q), len(s))" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    n_q, n_s = map(int, out.stdout.split())
    assert n_q > n_s > 40


def test_library_queries_do_not_need_the_llm_subpackage(monkeypatch):
    import __spark_entry__ as E
    from sparkjourney.plans import QUERIES
    monkeypatch.setattr(E, "_llm", lambda: None)
    assert set(E.queries()) == set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
