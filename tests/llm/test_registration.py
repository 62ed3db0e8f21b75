from __future__ import annotations

import re

import __spark_entry__ as entry


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
