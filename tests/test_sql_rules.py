"""Queries and their SQL on small made-up tables that hold what the given ones hold only at size."""

import datetime as dt
import random

import duckdb
import pytest
from test_queries import plain

from lorewell.operators import capture
from lorewell.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """Writes tables (name: schema, rows) and gives a query's rows and those of its SQL over them."""

    def rows_of(name, **tables):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for table, (schema, rows) in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        cursor = con.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
        assert sorted(names) == columns
        return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr), sorted(want, key=repr)

    return rows_of


def test_a_notification_within_the_last_second_of_the_wait_is_not_due(both):
    at = [dt.datetime(2024, 1, 14), dt.datetime(2024, 1, 14, 0, 0, 0, 1), dt.datetime(2024, 1, 14, 0, 0, 0, 999_999), dt.datetime(2024, 1, 13, 23, 59, 59, 999_999), None]
    got, want = both("notifications_due", events=("event_id long, ts timestamp_ntz", [(3 * i + 2, t) for i, t in enumerate(at)]))
    assert got == want and dict(map(reversed, got)) == {2: True, 5: False, 8: False, 11: True, 14: True}


def test_parts_of_a_second_count(spark):
    rows = spark.createDataFrame([(1, "2024-01-14 23:59:58.300000"), (2, "2024-01-14 23:59:58.600000")], "key long, last_notified_at string")
    assert {r.key: r.due for r in capture.due(rows, "2024-01-15 00:00:00", 1.5).collect()} == {1: True, 2: False}


def test_all_references_of_html_are_resolved(both):
    draw = random.Random(7)
    parts = ["&", "&amp", "&amp;", "&lt;", "&nbsp;", "&notit;", "&NotEqualTilde;", "&bogus;", "&copy", "&eacute;", "&#38;", "&#x26", "&#0;", "&#1;", "&#13;", "&#128;", "&#xD800;", "&#xFFFE;", "&#x110000;", "&#99999999999999999999;", "&#X00041;", "&#;", "&'", ";", "#60;", "amp;", " ", "\n", "a", "é", "<b>", "</p>", "<style>x</STYLE>"]
    pages = [(0, None), (1, ""), (2, "and&amp\nby &amp;lt; &copyx"), *((i, "".join(draw.choices(parts, k=draw.randint(1, 12)))) for i in range(3, 2000))]
    got, want = both("page_texts", pages=("page_id long, html string", pages))
    assert got == want and {(2, "and&\nby &lt; ©x"), (0, "")} <= set(got)
