"""The dialect against hand-written answers: values, names, errors, plans."""

import datetime
from decimal import Decimal

import pytest

from stratal.plans.engine import Engine
from stratal.plans.errors import AnalysisError, DialectError, ParseError, ResourceExhausted

EVENTS = [
    (1, 10, 100, "IN", "mobile", "view", 10, 100, 1.5, True, 7),
    (2, 10, 101, "US", "desktop", "click", 20, 200, 2.5, False, None),
    (3, 11, 102, "IN", "mobile", "click", 30, 300, 3.5, True, 9),
    (4, 12, 103, "US", "mobile", "view", 40, 400, 4.5, False, 11),
]
NAMES = "event_id long, user_id long, timestamp long, country string, device string, event_type string, duration_ms long, bytes long, score double, success boolean, campaign_id long"
RECORDS = [
    (0, None, None, None),
    (1, (None, None), [], []),
    (2, ("NY", (None, "p")), [None], [None]),
    (3, ("LA", (90210, "p")), [(None, None, None)], [1, None, 2]),
    (4, ("IN", None), [(12, "a", []), None, (7, "b", [None, "x"])], [3, 4]),
]
RECORD = "record_id long, profile struct<city: string, detail: struct<zip: int, padding: string>>, items array<struct<price: bigint, name: string, tags: array<string>>>, samples array<bigint>"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("events", spark.createDataFrame(EVENTS, NAMES))
    e.register("records", spark.createDataFrame(RECORDS, RECORD))
    e.register("one", spark.createDataFrame([(1, Decimal("-1.05"), "x\\y", datetime.date(2024, 1, 31))], "i int, m decimal(18,2), s string, d date"))
    return e


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def test_three_valued_in(engine):
    got = rows(engine, "SELECT event_id, campaign_id NOT IN (7, NULL) AS x FROM events ORDER BY event_id")
    assert [x for _, x in got] == [False, None, None, None]


def test_windows(engine):
    got = rows(engine, "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY country ORDER BY event_id) AS n, SUM(bytes) OVER (PARTITION BY country ORDER BY event_id) AS s, LAG(bytes, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events ORDER BY event_id")
    assert got == [(1, 1, 100, 0), (2, 1, 200, 100), (3, 2, 400, 0), (4, 2, 600, 0)]


def test_running_frame_counts_rows_on_ties(engine):
    got = rows(engine, "SELECT event_id, COUNT(*) OVER (PARTITION BY country ORDER BY country) AS c FROM events")
    assert sorted(c for _, c in got) == [1, 1, 2, 2]


@pytest.mark.parametrize(
    "text, want",
    [
        ("9223372036854775807 + i", None),
        ("i / 0", None),
        ("i / 2", 0.5),
        ("m * m", Decimal("1.10")),
        ("m * CAST('1.05' AS DECIMAL(18,2))", Decimal("-1.10")),
        ("CAST(1.005 AS DECIMAL(18,2))", Decimal("1.00")),
        ("CAST(' 12 ' AS BIGINT)", None),
        ("CAST(2.0 AS VARCHAR)", "2"),
        ("SUBSTRING('abcdef', -2, 3)", "abc"),
        ("SUBSTRING('abcdef', 2, -1)", ""),
        ("UPPER('straße')", "STRAßE"),
        ("s LIKE 'x\\y'", True),
        ("s LIKE '%\\_'", True),
        ("DATE '2024-02-30'", None),
        ("d + INTERVAL '1 day'", datetime.date(2024, 2, 1)),
        ("d + INTERVAL '5 hours'", None),
        ("DATE_TRUNC('year', d)", datetime.date(2024, 1, 1)),
        ("EXTRACT(day FROM d)", 31),
        ("1 BETWEEN 5 AND NULL", False),
        ("NULLIF(i, 1) IN ()", None),
        ("i IN ()", False),
        ("ABS(-3)", 3),
        ("CONCAT('a', NULL)", None),
        ("CASE WHEN i = 2 THEN 'two' END", None),
        ("NOT i = 2", True),
        ("COALESCE(NULL, 'é')", "é"),
        ("TIMESTAMP '2024-01-05T06:07:08.9Z' - INTERVAL '1 minute'", datetime.datetime(2024, 1, 5, 6, 6, 8)),
    ],
)
def test_values(engine, text, want):
    got = rows(engine, f"SELECT {text} AS v FROM one")[0][0]
    assert got == want and (want is None or type(got) is type(want))


def test_struct_paths_and_containers(engine):
    got = rows(engine, "SELECT record_id, profile.detail.zip AS z, CARDINALITY(samples) AS n FROM records r ORDER BY record_id")
    assert got == [(0, None, None), (1, None, 0), (2, None, 1), (3, 90210, 3), (4, None, 2)]
    assert rows(engine, "SELECT record_id FROM records WHERE profile.detail IS NOT NULL ORDER BY record_id") == [(2,), (3,)]
    ordered = rows(engine, "SELECT record_id, samples FROM records ORDER BY samples NULLS FIRST")
    assert [r for r, _ in ordered] == [0, 1, 2, 3, 4]


def test_unnest(engine):
    got = rows(engine, "SELECT record_id, u.value AS v, u.ordinality AS o FROM records CROSS JOIN UNNEST(samples) WITH ORDINALITY AS u ORDER BY record_id, o")
    assert got == [(2, None, 1), (3, 1, 1), (3, None, 2), (3, 2, 3), (4, 3, 1), (4, 4, 2)]
    left = rows(engine, "SELECT record_id, u.v, u.p FROM records LEFT JOIN UNNEST(samples) WITH ORDINALITY AS u(v, p) ON u.v > 1 AND u.p > 1 ORDER BY record_id")
    assert left == [(0, None, None), (1, None, None), (2, None, None), (3, 2, 3), (4, 4, 2)]
    chain = rows(engine, "SELECT record_id, i.value.price AS p, t.value AS tag FROM records, UNNEST(items) AS i LEFT JOIN UNNEST(i.value.tags) AS t ON t.value IS NOT NULL ORDER BY record_id, p")
    assert chain == [(2, None, None), (3, None, None), (4, 7, "x"), (4, 12, None), (4, None, None)]
    pair = rows(engine, "SELECT a.value AS x FROM records, UNNEST(samples) AS a INNER JOIN UNNEST(samples) AS b ON a.value = b.value WHERE record_id = 3 ORDER BY x")
    assert pair == [(1,), (2,)]


def test_output_names_star_and_union(engine):
    assert engine.sql("SELECT r.profile.city, record_id + 1 FROM records r").columns == ["city", "column2"]
    assert engine.sql("SELECT * FROM records, UNNEST(samples) WITH ORDINALITY AS u").columns == ["record_id", "profile", "items", "samples", "value", "ordinality"]
    assert sorted(rows(engine, "WITH a AS (SELECT i FROM one) SELECT i FROM a UNION SELECT i FROM a UNION ALL SELECT i FROM a")) == [(1,), (1,)]


def test_order_defaults_and_ties(engine):
    got = rows(engine, "SELECT campaign_id, event_id FROM events ORDER BY campaign_id")
    assert [e for _, e in got] == [1, 3, 4, 2]
    got = rows(engine, "SELECT campaign_id, event_id FROM events ORDER BY campaign_id DESC LIMIT 2")
    assert got == [(None, 2), (11, 4)]
    assert rows(engine, "SELECT country, event_id FROM events ORDER BY country LIMIT 1 OFFSET 1") == [("IN", 3)]


def test_subqueries(engine):
    assert rows(engine, "SELECT event_id FROM events e WHERE bytes = (SELECT MAX(i.bytes) FROM events i WHERE i.country = e.country) ORDER BY event_id") == [(3,), (4,)]
    assert rows(engine, "SELECT event_id FROM events WHERE campaign_id NOT IN (SELECT campaign_id FROM events)") == []
    assert rows(engine, "SELECT (SELECT event_id FROM events WHERE event_id > 99) AS x FROM one") == [(None,)]


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT nothing FROM events", "unknown column"),
        ("SELECT event_id FROM nowhere", "unknown table"),
        ("SELECT a.event_id FROM events a JOIN events b ON event_id = 1", "ambiguous"),
        ("SELECT event_id FROM events WHERE bytes", "BOOLEAN"),
        ("SELECT d = '2024-01-01' AS x FROM one", "incompatible"),
        ("SELECT country, COUNT(*) AS n FROM events", "grouped"),
        ("SELECT SUM(MAX(bytes)) AS x FROM events", "nest"),
        ("SELECT SUM(country) AS x FROM events", "does not take"),
        ("SELECT ROUND(score) AS x FROM events", "unsupported function"),
        ("SELECT items.price FROM records", "UNNEST"),
        ("SELECT u.value FROM records, UNNEST(profile) AS u", "LIST"),
        ("SELECT record_id FROM records RIGHT JOIN UNNEST(samples) AS u ON TRUE", "RIGHT"),
        ("SELECT CAST(samples AS VARCHAR) AS x FROM records", "CAST"),
        ("SELECT samples + 1 AS x FROM records", "does not take"),
        ("SELECT event_id FROM events ORDER BY bytes", "ORDER BY"),
        ("SELECT COUNT(DISTINCT bytes) AS x FROM events", "DISTINCT"),
        ("WITH RECURSIVE a AS (SELECT 1 AS x FROM one) SELECT x FROM a", "recursive"),
        ("SELECT event_id", "FROM"),
        ("SELECT NTILE(4) OVER (ORDER BY bytes) AS x FROM events", "window"),
        ("SELECT event_id FROM events WHERE profile @ 1", "unexpected"),
    ],
)
def test_errors(engine, text, error):
    with pytest.raises(DialectError, match=error):
        engine.sql(text)


def test_prepared_and_limits(engine, spark):
    p = engine.prepare("SELECT i, s FROM one")
    assert p.output_schema == [("i", "bigint"), ("s", "string")] and len(p.execute().collect()) == 1
    with pytest.raises(ResourceExhausted):
        engine.sql("SELECT event_id FROM events", max_rows=3)
    e = Engine(spark).register("t", spark.createDataFrame([(1,)], "a int"))
    p = e.prepare("SELECT a FROM t")
    e.register("t", spark.createDataFrame([("x",)], "a string"))
    with pytest.raises(AnalysisError, match="schema changed"):
        p.execute()
    # a table with the same fields is read as it is then; other tables do not matter
    e.register("t", spark.createDataFrame([(1,)], "a int"))
    p = e.prepare("SELECT a FROM t")
    e.register("t", spark.createDataFrame([(2,)], "a int")).register("u", spark.range(2).toDF("z")).register("u", spark.createDataFrame([("x",)], "y string"))
    assert [r.a for r in p.execute().collect()] == [2] and [r.a for r in p.execute(max_rows=1).collect()] == [2]
    assert sum(t.name.startswith("stratal_t_") for t in spark.catalog.listTables()) >= 1
    with pytest.raises(ParseError):
        e.prepare("SELECT")


def test_values_beyond_their_range(engine):
    got = rows(engine, "SELECT CAST(9223372036854775807 AS TIMESTAMP) AS a, CAST(-9223372036854775807 AS DATE) AS b, d + INTERVAL '99999999999 days' AS c, TIMESTAMP '2024-01-01 00:00:00' - INTERVAL '99999999999 days' AS e, d - INTERVAL '31 days' AS f, TIMESTAMP '2024-01-01 00:00:00' - INTERVAL '1 minute' AS g FROM one")
    assert [tuple(x if x is None or not isinstance(x, datetime.datetime) else x.replace(tzinfo=None) for x in r) for r in got] == [(None, None, None, None, datetime.date(2023, 12, 31), datetime.datetime(2023, 12, 31, 23, 59))]
    got = rows(engine, "SELECT CAST(100000000.0 AS VARCHAR) AS a, CAST(0.00000125 AS VARCHAR) AS b, CAST(-12345678.25 AS VARCHAR) AS c, CAST(1.5 AS VARCHAR) AS d, CONCAT(30000000.0, '') AS e FROM one")
    assert got == [("100000000", "0.00000125", "-12345678.25", "1.5", "30000000")]


def test_lag_by_row(engine):
    got = rows(engine, "SELECT event_id, LAG(bytes, event_id - 2) OVER (ORDER BY event_id) AS a, LEAD(bytes, NULLIF(event_id, 1), -1) OVER (ORDER BY event_id) AS b FROM events ORDER BY event_id")
    # an offset below 0 or NULL is 1
    assert got == [(1, None, 200), (2, 200, 400), (3, 200, -1), (4, 200, -1)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.i FROM one a JOIN one b USING (i)",
        "SELECT i FROM one NATURAL JOIN events",
        "SELECT i FROM one INTERSECT SELECT i FROM one",
        "SELECT i FROM one EXCEPT SELECT i FROM one",
        "SELECT i, s FROM one UNION ALL SELECT i FROM one",
        "SELECT r.record_id FROM records r CROSS JOIN UNNEST(u.value.tags) AS t CROSS JOIN UNNEST(r.items) AS u",
        "SELECT LAG(bytes, 'x') OVER (ORDER BY event_id) AS a FROM events",
    ],
)
def test_what_the_dialect_refuses(engine, text):
    with pytest.raises(DialectError):
        engine.sql(text)


def test_plans(engine, spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(1000).selectExpr("id", "id % 7 AS k", "named_struct('a', id, 'B', 'x') AS s").write.parquet(path)
    e = Engine(spark).register("t", spark.read.parquet(path))
    plan = e.explain("SELECT id FROM t WHERE k > 3")
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,3)]" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    assert "ReadSchema: struct<s:struct<B:string>>" in e.explain("SELECT s.b FROM t")
    assert "TakeOrderedAndProject" in e.explain("SELECT id FROM t ORDER BY id DESC LIMIT 3 OFFSET 2")
    assert "BroadcastHashJoin" in e.explain("SELECT a.id FROM t a JOIN t b ON a.id = b.id")


def test_contradictions_read_nothing(engine):
    plan = engine.explain("SELECT event_id FROM events WHERE bytes > 10 AND bytes BETWEEN 2 AND 5 AND country = 'IN'")
    assert "LocalTableScan" in plan and "<empty>" in plan
    assert rows(engine, "SELECT COUNT(*) AS n FROM events WHERE bytes >= 10 AND 5 > bytes") == [(0,)]
    assert len(rows(engine, "SELECT event_id FROM events WHERE bytes >= 100 AND 100 >= bytes")) == 1
