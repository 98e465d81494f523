"""The driver's entry with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import re, __spark_entry__ as e; q = e.queries(); print(len(q), sum(bool(re.match(r'op[0-9]|pipeline', k)) for k in q), len(set(e.oracle_sql()) - set(q)))"


def counts(folder: Path, before: str = "") -> list[int]:
    done = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return [int(x) for x in done.stdout.split()]


@pytest.fixture
def without_corpus(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    return shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)


def test_entry_without_the_corpus_folders(without_corpus):
    queries, corpus, loose = counts(without_corpus)
    assert queries > 50 and corpus == 0 and loose == 0


def test_entry_with_the_pipeline_but_no_folders(without_corpus):
    (without_corpus / "corpus_pipeline.py").write_text("from cladeloom.llm import decontaminate\n")
    assert counts(without_corpus)[0] > 50


def test_entry_without_what_the_corpus_operators_need():
    queries, corpus, _ = counts(ROOT, "import sys; sys.modules['xxhash'] = None; ")
    assert queries > 50 and corpus == 0
