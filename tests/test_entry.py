import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(block: str) -> set[str]:
    code = f"import sys; sys.modules.update({{n: None for n in {block}}}); import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()
    assert set(out[-1].split()) <= set(out[-2].split())
    return set(out[-2].split())


def test_entry_works_without_the_subpackage():
    bare = names("['scenarium.llm', 'corpus_pipeline']")
    assert bare and not any(n.startswith("op") or n == "pipeline" for n in bare)
    assert names("['corpus_pipeline']") >= bare
