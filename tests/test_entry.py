import __spark_entry__ as entry


def test_names_and_flagship(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_training_operators():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('stemweave.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'j01_star_join' in e.queries() and e.oracle_sql()\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=300).returncode == 0
