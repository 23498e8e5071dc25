import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_folders(tmp_path):
    for part in ("granary", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "granary" / "llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, sql, ops = map(int, said.stdout.split())
    assert n > 50 and sql > 50 and ops == 0
