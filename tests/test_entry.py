"""The entry points work with and without the training-data package."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from logwarden.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def names_without(*modules: str) -> set[str]:
    """Query names in a new interpreter that can't find the modules."""
    hide = f"import sys; sys.modules.update(dict.fromkeys({modules!r}))"
    code = f"{hide}; import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_package_can_be_missing():
    own = set(catalog.QUERIES)
    assert names_without("corpus_pipeline", "logwarden.llm") == own
    assert names_without("logwarden.llm") == own
    assert names_without("xxhash") == own  # a library that only the package uses
    assert own < set(__spark_entry__.queries()) or own == set(__spark_entry__.queries())
