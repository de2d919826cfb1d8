"""Sources, sinks, helpers, value functions, serving."""

import datetime
import io
import json
import time
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratal.functions import semantics as M
from stratal.operators import helpers, shredding
from stratal.plans.engine import Engine
from stratal.plans.errors import AnalysisError, JobFailed, MemoryLimit, ResourceExhausted
from stratal.plans.serving import CYCLE, Job, Scheduler, Server, admitted
from stratal.sinks import arrow_file, ndjson
from stratal.sources import arrow_ipc, column_file, files, nested_scan
from stratal.streaming import batches


def test_csv_star(spark, tmp_path):
    (tmp_path / "events.csv").write_text("event_id,user_id,timestamp,country,device,event_type,duration_ms,bytes,score,success,campaign_id\n1,10,100,IN,mobile,view,10,100,1.5,true,7\n2,10,101,US,desktop,click,20,200,2.5,false,\n")
    (tmp_path / "users.csv").write_text("user_id,segment,signup_date,lifetime_value,region,active\n10,pro,2020-01-02,12.30,emea,true\n")
    (tmp_path / "campaigns.csv").write_text("campaign_id,campaign_name,budget,start_date,end_date,channel\n7,c,100.00,2024-01-01,2024-02-01,email\n")
    engine = Engine(spark)
    for name, df in files.read_star(spark, f"{tmp_path}/events.csv").items():
        engine.register(name, df)
    got = engine.sql("SELECT event_id, campaign_name, lifetime_value FROM events e LEFT JOIN campaigns c ON e.campaign_id = c.campaign_id JOIN users u ON u.user_id = e.user_id ORDER BY event_id").collect()
    assert [tuple(r) for r in got] == [(1, "c", Decimal("12.30")), (2, None, Decimal("12.30"))]


def test_column_file(spark, tmp_path):
    rows = [{"event_id": i, "user_id": i % 3, "timestamp": i, "country": "IÑ", "device": "m", "event_type": "view" if i % 2 else "click", "duration_ms": i, "bytes": i * 10, "score": i / 2, "success": i % 2 == 0, "campaign_id": None if i % 4 == 0 else i} for i in range(10)]
    column_file.write_columns(rows, f"{tmp_path}/events.col")
    got = [r.asDict() for r in column_file.read_columns(spark, f"{tmp_path}/events.col").orderBy("event_id").collect()]
    assert got == rows
    (tmp_path / "bad.col").write_bytes(b"nothing here at all....")
    with pytest.raises(Exception, match="not a column file"):
        column_file.read_columns(spark, f"{tmp_path}/bad.col").collect()


def test_arrow_round_trip(spark, tmp_path):
    path = f"{tmp_path}/t.arrow"
    df = spark.sql("SELECT id, named_struct('x', array(id, NULL)) AS s FROM range(5)")
    assert arrow_file.write_arrow(df, path) == 5
    assert [tuple(r) for r in arrow_ipc.read_arrow(spark, path).orderBy("id").collect()] == [tuple(r) for r in df.collect()]
    with pytest.raises(FileExistsError):
        arrow_file.write_arrow(df, path)
    table = pa.table({"d": pa.array(["a", None, "a"]).dictionary_encode(), "u": pa.array([1, 2, 3], pa.uint8()), "f": pa.array([[1, 2], None, [3, 4]], pa.list_(pa.int32(), 2))})
    with pa.ipc.new_file(f"{tmp_path}/d.arrow", table.schema) as w:
        w.write_table(table)
    assert [tuple(r) for r in arrow_ipc.read_arrow(spark, f"{tmp_path}/d.arrow").collect()] == [("a", 1, [1, 2]), (None, 2, None), ("a", 3, [3, 4])]


def test_ndjson(spark):
    df = spark.sql("SELECT 1L AS i, 1.50BD AS d, 0.1D AS f, true AS b, 'é\"' AS s, DATE '2024-01-02' AS dt, TIMESTAMP '1970-01-02 00:00:01' AS ts, named_struct('a', array(1L, NULL)) AS n, CAST(NULL AS string) AS z")
    out = io.StringIO()
    assert ndjson.write_ndjson(df, out) == 1
    got = json.loads(out.getvalue())
    assert [x and x["t"] for x in got] == ["i", "d", "f", "b", "s", "s", "i", "struct", None]
    assert got[1]["v"] == "1.50" and got[2]["v"] == 0.1 and got[6]["v"] == 86401 and got[7]["v"]["a"]["v"][1] is None
    with pytest.raises(ResourceExhausted):
        ndjson.write_ndjson(spark.range(5).toDF("i"), io.StringIO(), max_rows=4)


def test_batches(spark):
    assert [len(b) for b in batches.rows(spark.range(10), 4)] == [4, 4, 2]
    assert sum(b.num_rows for b in batches.record_batches(spark.range(10))) == 10


def test_nested_scan(spark, tmp_path):
    path = f"{tmp_path}/n.parquet"
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": list(range(10)), "p": [{"a": i, "b": {"c": i, "d": "x"}} for i in range(10)], "l": [[{"u": 1, "v": 2}]] * 10}), path, row_group_size=4)
    df = nested_scan.scan(spark, path, ["l.u", "p.b.c"])
    assert df.schema.simpleString() == "struct<p:struct<b:struct<c:bigint>>,l:array<struct<u:bigint>>>"
    assert [r.id for r in nested_scan.scan(spark, path, ["id"], [2, 0]).orderBy("id").collect()] == [0, 1, 2, 3, 8, 9]
    assert nested_scan.scan(spark, path, ["id"], []).count() == 0
    for bad in ([3], [0, 0]):
        with pytest.raises(AnalysisError):
            nested_scan.scan(spark, path, ["id"], bad)
    with pytest.raises(AnalysisError):
        nested_scan.scan(spark, path, ["p.z"])
    assert {x["path"] for x in nested_scan.summary(spark, path)} >= {"id", "p.b.c"}


def test_shredding(spark):
    docs = spark.createDataFrame([(1, [("u", [("en", "us"), (None, None)]), (None, [])]), (2, [])], "doc_id long, names array<struct<url: string, languages: array<struct<code: string, country: string>>>>")
    got = [(r.doc_id, r.value, r.repetition, r.definition) for r in shredding.shred(docs).orderBy("doc_id", "place", "inner").collect()]
    assert got == [(1, "en", 0, 3), (1, None, 2, 2), (1, None, 1, 1), (2, None, 0, 0)]
    assert {r.doc_id: r.names for r in shredding.assemble(shredding.shred(docs)).collect()} == {1: [["en", None], []], 2: []}


def test_helpers(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "k int, v int")
    assert [r.k for r in helpers.top_k(df, [("v", False)], 2).collect()] == [1, 2]
    assert [r.s for r in helpers.running(df, "s", F.count("*"), [], [("v", True)]).collect()] == [1, 2, 3]
    big = spark.createDataFrame([(2**63 - 1,), (1,), (-1,)], "x long")
    assert big.agg(helpers.exact_sum(F.col("x"))).first()[0] == 2**63 - 1
    assert big.where("x > 0").agg(helpers.exact_sum(F.col("x"))).first()[0] is None


def test_semantics(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    lit = lambda x, t: F.lit(x).cast(t)
    assert get(M.safe_add(F.lit(2**63 - 1), F.lit(1))) is None and get(M.safe_subtract(F.lit(3), F.lit(1))) == 2
    assert get(M.safe_multiply(F.lit(2**62), F.lit(2))) is None and get(M.safe_divide(F.lit(1), F.lit(0))) is None
    assert get(M.safe_abs(F.lit(-(2**63)))) is None and get(M.money_multiply(lit("-1.05", "decimal(18,2)"), lit("1.05", "decimal(18,2)"))) == Decimal("-1.10")
    assert get(M.money_of(F.lit(1.005))) == Decimal("1.00") and get(M.money_add(F.lit(1), F.lit(2))) == Decimal("3.00")
    assert get(M.whole_of(F.lit(" 1"))) is None and get(M.strict_date(F.lit("2024-1-1"))) is None
    assert get(M.strict_timestamp(F.lit("2024-01-01T00:00:09.7Z"))) == datetime.datetime(2024, 1, 1, 0, 0, 9)
    assert get(M.ascii_lower(F.lit("ÉA"))) == "Éa" and get(M.ascii_upper(F.lit("éa"))) == "éA"
    assert get(M.substring(F.lit("abc"), F.lit(-1), F.lit(2))) == "ab" and get(M.like(F.lit("a\\b"), "a\\_")) is True
    assert get(M.date_plus_seconds(lit("2024-01-01", "date"), F.lit(3600))) is None


def test_strict_timestamps(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.5' AS t")
    with pytest.raises(Exception, match="fraction"):
        Engine(spark).register("t", df).sql("SELECT t FROM t").collect()
    assert Engine(spark).register("t", df, timestamps="cut").sql("SELECT t FROM t").first()[0].microsecond == 0
    e = Engine(spark).register("t", spark.sql("SELECT map(1, 2) AS m, 3 AS x"))
    assert e.sql("SELECT x FROM t").first()[0] == 3
    with pytest.raises(AnalysisError, match="not supported"):
        e.sql("SELECT m FROM t")


def test_scheduler(spark):
    engine = Engine(spark).register("t", spark.range(100).toDF("i"))
    s = Scheduler(engine, active=2, queue=3)
    got = [s.submit("SELECT COUNT(*) AS n FROM t", priority=p, group=str(p)) for p in (0, 1, 2)]
    assert [s.result(n)[0][0] for n in got] == [100] * 3
    late = s.submit("SELECT COUNT(*) AS n FROM t a CROSS JOIN t b CROSS JOIN t c CROSS JOIN t d CROSS JOIN t e", timeout=1.0)
    assert s.wait(late, 30)["phase"] == "deadline"
    s.waiting[0].clear()
    assert CYCLE.count(2) == 4 and CYCLE.count(1) == 2 and CYCLE.count(0) == 1
    with pytest.raises(ResourceExhausted):
        admitted(spark.range(10**9), 1)


def test_scheduler_limits(spark):
    engine = Engine(spark).register("t", spark.range(100).toDF("i"))
    s = Scheduler(engine, active=3)
    job = lambda group, need=0: Job(0, engine.prepare("SELECT i FROM t"), 1, group, None, 0.0, bytes=need)
    s.running = {1: job("a")}
    assert s._fits(job("a"))  # half of three places, rounded up
    s.running[2] = job("a")
    assert not s._fits(job("a")) and s._fits(job("b"))
    s = Scheduler(engine, active=8, memory_mb=10, group_mb=4)
    s.running = {1: job("a", 3 << 20)}
    assert not s._fits(job("a", 2 << 20)) and s._fits(job("b", 2 << 20))
    s.running |= {2: job("b", 4 << 20)}
    assert not s._fits(job("c", 4 << 20)) and s._fits(job("c", 3 << 20))
    big = Engine(spark).register("t", spark.range(10**8).toDF("i"))
    with pytest.raises(MemoryLimit, match="ADMISSION_REJECTED"):
        Scheduler(big, memory_mb=1).submit("SELECT i FROM t")
    with pytest.raises(ValueError, match="priorities"):
        s.submit("SELECT i FROM t", priority=3)


def test_stopped_before_its_tag(spark):
    """A job that is stopped between its start and its tag runs nothing and frees its place."""
    engine = Engine(spark).register("t", spark.range(3).toDF("i"))
    s = Scheduler(engine)
    j = Job(7, engine.prepare("SELECT i FROM t"), 1, "g", None, 0.0, phase="cancelled")
    s.jobs[7] = s.running[7] = j
    s._run(j)
    assert not s.running and j.rows is None and j.phase == "cancelled"
    j.finished.set()
    with pytest.raises(JobFailed):
        s.result(7)


def test_server(spark):
    server = Server(Engine(spark).register("t", spark.range(7).toDF("i")))
    assert server.handle("PREPARE q SELECT i FROM t WHERE i > 2") == "OK q"
    assert server.handle("EXEC q").startswith("OK 4 ") and server.handle("E2E SELECT i FROM t").startswith("OK 7 ")
    assert "Filter" in server.handle("EXPLAIN q")
    number = server.handle("SUBMIT q priority=2 timeout_ms=60000").split()[1]
    assert "completed" in server.handle(f"WAIT {number}")
    assert server.handle("EXEC nothing").startswith("ERROR") and server.handle("PREPARE b SELECT z FROM t").startswith("ERROR")
    out = io.StringIO()
    server.serve(["SHUTDOWN", "EXEC q"], out)
    assert out.getvalue() == "OK\n"
    time.sleep(0)


def test_server_cuts_no_result(spark):
    server = Server(Engine(spark).register("t", spark.range(7).toDF("i")))
    assert server.handle("PREPARE q SELECT i FROM t") == "OK q"
    assert server.handle("CONFIG max_rows 6") == "OK"
    assert server.handle("EXEC q").startswith("ERROR ResourceExhausted") and server.handle("E2E SELECT i FROM t").startswith("ERROR ResourceExhausted")
    assert server.handle("CONFIG max_rows 7") == "OK"
    assert server.handle("EXEC q").startswith("OK 7 ") and server.handle("E2E SELECT i FROM t").startswith("OK 7 ")


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


WHOLE = {"three_valued": "events", "ascii_case_only": "documents", "interval_arith": "orders", "join_full": "customer", "unnest_product": "orders"}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, tiny, name):
    import __spark_entry__ as e

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "customer", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tiny}/{t}.parquet'")
    got = [tuple(r) for r in e.queries()[name](spark, tiny).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(e.oracle_sql()[name]).fetchall(), key=repr)
    keys = {r[0] for r in got} - {None}
    column = {"events": "event_id", "documents": "doc_id", "orders": "o_orderkey", "customer": "c_custkey"}[WHOLE[name]]
    all_keys = {r[0] for r in spark.read.parquet(f"{tiny}/{WHOLE[name]}.parquet").select(column).collect()}
    # an order of one line has no pair
    assert keys <= all_keys and max(keys) > 0.9 * max(all_keys) and (keys == all_keys or name == "unnest_product")


def test_new_queries_on_the_second_engine(spark, tiny):
    """Queries whose oracle is no copy of their text."""
    duckdb = pytest.importorskip("duckdb")
    from stratal.plans import catalog

    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{tiny}/{t}.parquet'")
    for name in ("time_overflow_null", "double_text", "win_offset_by_row", "container_compare", "container_minmax", "unnest_left_on", "unnest_helper", "having_subquery", "on_subquery"):
        df, want = catalog.QUERIES[name](spark, tiny), con.execute(catalog.ORACLES[name])
        assert df.columns == [d[0] for d in want.description], name
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr), name


def test_sinks_of_executors(spark, tmp_path):
    from stratal.streaming.batches import must_stream, record_batches

    df = spark.range(20, numPartitions=3).selectExpr("id", "IF(id % 3 = 0, NULL, named_struct('a', id, 'b', array(1.5D, NULL))) AS s", "CAST(id AS DECIMAL(18,2)) AS d", "DATE '2024-01-02' AS day", "TIMESTAMP '2024-01-02 03:04:05' AS t")
    assert [r[0] for r in ndjson.typed_lines(df).collect()] == list(ndjson.lines(df))
    ndjson.write_ndjson_folder(df, f"{tmp_path}/out")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(ndjson.lines(df))
    got = list(record_batches(df, 4))
    assert all(b.num_rows <= 4 for b in got) and [x for b in got for x in b.column("id").to_pylist()] == list(range(20))
    assert [x for b in got for x in b.column("s").to_pylist()][1] == {"a": 1, "b": [1.5, None]}
    assert must_stream(df.where("id > 3")).count() == 16
    with pytest.raises(ResourceExhausted, match="STREAMING_UNSUPPORTED"):
        must_stream(df.orderBy("d"))


def test_command_line(spark, tmp_path, capsys):
    from stratal.__main__ import main

    spark.range(6).selectExpr("id", "struct(id AS a) AS s").coalesce(1).write.parquet(f"{tmp_path}/d")
    (path,) = [str(p) for p in (tmp_path / "d").glob("*.parquet")]
    assert main(["query", "--data", path, "--table", "t", "--sql", "SELECT s.a FROM t WHERE id > 3 ORDER BY a", "--stats"]) == 0
    said = capsys.readouterr()
    assert said.out == '[{"t":"i","v":4}]\n[{"t":"i","v":5}]\n' and json.loads(said.err.splitlines()[-1])["rows"] == 2
    assert main(["scan", "--data", path, "--columns", "s.a", "--output", f"{tmp_path}/o.arrow"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 6
    assert main(["query", "--data", path, "--table", "t", "--sql", "SELECT z FROM t"]) == 1
