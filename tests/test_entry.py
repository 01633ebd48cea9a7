"""The driver's contract, also without the corpus operators."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path


import __spark_entry__
from quantloom.operators import research as R
from quantloom.sources.tables import embedding_columns

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    importlib.reload(__spark_entry__)
    made = __spark_entry__.entry(spark).collect()
    assert len(made) > 0 and set(made[0].asDict()) == {"key", "n_events", "n_upper", "n_lower", "hit_ratio", "mean_return"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "quantloom", tmp_path / "quantloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_large_clusters(spark):
    assert R.kmeans_rows(embedding_columns(spark, SF, 4), ["e0", "e1", "e2", "e3"], 3, 10).select("cluster").distinct().count() == 3
