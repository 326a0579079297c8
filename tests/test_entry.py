"""The driver's contract, also without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_corpus(tmp_path):
    for p in ("girder", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "girder").mkdir()
    for p in (ROOT / "girder").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "girder" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["rule_id", "severity", "path", "line_start", "line_end", "subject", "detail"]
    assert df.count() > 0
