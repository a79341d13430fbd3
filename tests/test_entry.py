import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout


def test_lists_queries_without_a_session():
    assert int(run("import __spark_entry__ as e; print(len(e.queries()))")) > 50
    assert run("import __spark_entry__ as e; print(set(e.oracle_sql()) - set(e.queries()))").strip() == "set()"


def test_core_stands_alone():
    block = "import sys; sys.modules['bidloom.llm'] = None\nimport pkgutil, importlib, bidloom\n"
    block += "[importlib.import_module(m.name) for m in pkgutil.walk_packages(bidloom.__path__, 'bidloom.') if not m.name.startswith('bidloom.llm')]\nprint('ok')"
    assert run(block).strip() == "ok"


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["item", "offers", "least", "most", "middle", "lowest", "highest", "spread"]
