"""The entry point with parts missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from rivulint.checks.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "corpus_pipeline",
                                     "rivulint.llm", "rivulint.llm.queries"])
def test_a_missing_package_costs_only_what_needs_it(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    n_queries, n_texts, has_pipeline = out.stdout.split()
    assert int(n_queries) >= len(QUERIES) and int(n_texts) >= len(QUERIES), out.stderr
    assert has_pipeline == "False"
