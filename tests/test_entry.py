import re
from pathlib import Path

import __spark_entry__ as entry


def test_catalogue():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) > 80 and set(s) <= set(q)
    for n in (3, 4, 6, 7):
        assert f"p{n}_found" in q


def test_core_does_not_import_llm():
    root = Path(entry.__file__).parent / "flowloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+flowloom\.llm", p.read_text(), re.M), p
