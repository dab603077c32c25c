"""The driver's contract, with and without the separable add-on."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_without_addon(tmp_path):
    for p in ("__spark_entry__.py", "kvjoin"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "kvjoin").mkdir()
    for p in (ROOT / "kvjoin").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "kvjoin" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op1_') for x in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(sys.path)}".replace(str(ROOT), str(tmp_path))})
    assert done.returncode == 0, done.stderr


def test_addon_that_cannot_be_imported():
    """A package that the add-on needs is missing: the other queries still work."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
