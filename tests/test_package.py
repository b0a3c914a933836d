import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "rostrum"


def test_nothing_outside_imports_the_subpackage():
    for f in ROOT.rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            if isinstance(node, ast.ImportFrom):  # also "from rostrum import llm" and relative forms
                names = [f"{node.module or ''}.{a.name}" for a in node.names]
            else:
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
