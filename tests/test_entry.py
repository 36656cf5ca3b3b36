import importlib
import sys


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("spandrel.llm", "corpus_pipeline") else real(name, *a))
    entry = importlib.reload(sys.modules.get("__spark_entry__") or importlib.import_module("__spark_entry__"))
    names = entry.queries()
    assert names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_library_never_imports_the_corpus_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "spandrel"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "spandrel.llm" not in file.read_text(), file
