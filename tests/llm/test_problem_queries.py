import re

import parity
import pytest

from lucerna.llm import queries

FOUND = {"p1_found": ["shader_id", "raw_value", "topic_key"], "p2_found": ["shader_id"], "p3_found": ["unit", "unit_key", "finding"], "p4_found": ["shader_id", "lang"], "p5_found": ["shader_id_a", "shader_id_b"], "p6_found": ["target_id"],
         "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    got = queries.queries()[name](spark, data)
    if name in FOUND:
        assert got.columns == FOUND[name]
    rows = got.toPandas()
    if name != "p7_ids":
        assert len(rows) == len(rows.drop_duplicates()), "no row twice"
    sql = queries.oracle_sql().get(name)
    if sql:
        assert parity.rows(rows) == parity.rows(parity.connect(data).execute(sql).df())


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"lucerna\.llm|from \.+llm", f.read_text()), f
