"""The library and its entry work when the optional subpackage and the pipeline are gone."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


CODE = "import __spark_entry__ as e; q = e.queries(); assert 'scorecard' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"


def _copied(to, *names, without=("llm",)):
    for name in names:
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, to / name, ignore=shutil.ignore_patterns(*without, "__pycache__"))
        else:
            shutil.copy(source, to / name)


def _run(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline", "the pipeline and an empty folder"])
def test_entry_imports_without_the_subpackage(tmp_path, left):
    """Whether or not the pipeline's file, or a folder without modules, is left behind."""
    _copied(tmp_path, "revlens", "__spark_entry__.py")
    if "pipeline" in left and (ROOT / "corpus_pipeline.py").exists():
        _copied(tmp_path, "corpus_pipeline.py")
    if "folder" in left:
        (tmp_path / "revlens" / "llm" / "__pycache__").mkdir(parents=True)
    done = _run(tmp_path, CODE)
    assert done.returncode == 0, done.stderr


def test_errors_inside_are_not_swallowed(tmp_path):
    _copied(tmp_path, "revlens", "__spark_entry__.py")
    (tmp_path / "revlens" / "llm").mkdir()
    (tmp_path / "revlens" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    done = _run(tmp_path, CODE)
    assert done.returncode != 0 and "no_such_module_anywhere" in done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "revlens").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "revlens").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
