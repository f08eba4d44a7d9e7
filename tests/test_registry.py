import re

import __spark_entry__ as entry


def test_every_query_has_a_twin_or_a_reason():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert {q for q in without if not re.match(r"op\d+_|pipeline$", q)} == set()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_of_the_inventory_is_registered():
    want = {f"{g}{n:02}" for g, top in {"a": 17, "b": 18, "p": 7, "c": 8, "d": 11, "f": 23, "v": 8, "e": 7, "g": 14}.items()
            for n in range(1, top + 1)}
    assert want <= {name[:3] for name in entry.queries()}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "customer_id" in df.columns
