import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['corpusq.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "corpusq")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                text = open(os.path.join(folder, n)).read()
                assert not re.search(r"\bllm\b", text), f"{folder}/{n}"
