"""The format `statement_csv`: what it reads, what it refuses, and that a write shows whole or not at all."""

import pytest
from ledgerloom.functions.money import parse_money
from ledgerloom.sources import statement_csv, verified_csv
from ledgerloom.sources.statement_csv import COLUMNS, StatementCsv, StatementCsvWriter
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

HEAD = ",".join(COLUMNS)
META = "acct,CAD,2026-01-01,2026-01-31,100.00,130.00,20.00,50.00"
GOOD = f"{HEAD}\n{META},2026-01-02,SALE,,50.00,150.00\n{META},2026-01-03,RENT,20.00,,130.00\n"


def test_records_of_a_file():
    got = lambda text: list(statement_csv.records(text.encode() if isinstance(text, str) else text))
    assert [r[9] for r in got(GOOD)] == ["SALE", "RENT"]
    assert got("﻿" + GOOD) == got(GOOD) == got(GOOD.replace("\n", "\r\n")) == got("\n" + GOOD.replace("\n", "\n\n"))
    quoted = GOOD.replace("SALE", '"SALE ""A"",\nsecond\r\nline"')
    assert got(quoted)[0][9] == 'SALE "A",\nsecond\r\nline' and got(quoted)[1] == got(GOOD)[1]
    lines = [x.split(",") for x in GOOD.strip().split("\n")]
    moved = "\n".join(",".join([*x[::-1], "more"]) for x in lines)  # other order, another column
    assert got(moved) == got(GOOD)
    assert got(f"{HEAD}\na,CAD\n")[0] == ["a", "CAD"] + [""] * 11
    for text, problem in [
        ("", "columns missing"), (HEAD, "no transactions"), (HEAD + "\n\n", "no transactions"), (GOOD.replace("balance\n", "rest\n", 1), "columns missing: balance"),
        (GOOD.encode() + b"\xff", "not UTF-8"), (GOOD.replace("SALE", '"SALE'), "not a CSV"), (GOOD.replace("SALE,", "SALE,,"), "line 2: 14 fields"),
    ]:
        with pytest.raises(ValueError, match=problem):
            got(text)


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(StatementCsv)
    files = {
        "good": GOOD, "quoted": GOOD.replace("SALE", '"two\nlines, ""quoted"""'), "flawed": GOOD.replace(",130.00\n", ",131.00\n"), "totals": GOOD.replace("20.00,50.00", "21.00,50.00"),
        "late": GOOD.replace("2026-01-03", "2026-02-03"), "unordered": GOOD.replace("2026-01-03", "2026-01-01"), "two": GOOD.replace("acct,CAD", "other,CAD", 1),
        "sides": GOOD.replace("SALE,,50.00", "SALE,1.00,50.00"), "none": GOOD.replace("SALE,,50.00", "SALE,,"), "euro": GOOD.replace("CAD", "EUR"), "blank": GOOD.replace("SALE", " "),
        "date": GOOD.replace("2026-01-02", "2026-1-2"), "reversed": GOOD.replace("2026-01-01,2026-01-31", "2026-01-31,2026-01-01"), "money": GOOD.replace("150.00\n", "15O.00\n"),
        "nobody": GOOD.replace("acct", " "), "empty": "", "headless": GOOD.split("\n", 1)[1], "open": GOOD.replace("RENT", '"RENT'),
    }
    below = tmp_path / "in" / "more"
    below.mkdir(parents=True)
    for i, (name, text) in enumerate(files.items()):
        ((tmp_path / "in") if i % 2 else below).joinpath(f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "in" / "notes.txt").write_text("no statement")
    return str(tmp_path / "in")


def outcome(parts):
    name = lambda c="source_file": F.regexp_extract(c, r"([a-z]+)\.csv$", 1)
    statements, rows, findings, rejects = parts
    return (
        {r[0]: r[1:] for r in statements.select(name(), "debits", "credits", "last_balance").collect()}, sorted(map(tuple, findings.select(name(), "code").collect())),
        {r[0]: r[1] for r in rejects.select(name(), "problem").collect()}, sorted(r[0] for r in rows.where(F.endswith("source_file", F.lit("/quoted.csv"))).select("description").collect()),
        sorted(r[0].split(":", 1)[1] for r in rows.where(F.endswith("source_file", F.lit("/good.csv"))).select("id").collect()),
    )


def test_files_are_read_flawed_or_rejected(spark, folder, monkeypatch):
    monkeypatch.setattr(statement_csv, "TASK_BYTES", 900)  # several tasks
    read = spark.read.format("statement_csv").load(folder)
    statements, findings, rejects, quoted, ids = outcome(verified_csv.verified_statements(read))
    assert sorted(statements) == ["flawed", "good", "quoted", "totals"] and len({tuple(x) for x in statements.values()}) == 2
    assert findings == [("flawed", "balance_mismatch"), ("flawed", "closing_differs"), ("totals", "totals_differ")]
    broken = {"empty", "headless", "open"}
    assert {k for k, v in rejects.items() if v != "records break the template"} == broken and "missing" in rejects["headless"] and "quote" not in rejects["two"]
    assert set(rejects) - broken == {"late", "unordered", "two", "sides", "none", "euro", "blank", "date", "reversed", "money", "nobody"}
    assert quoted == ["RENT", 'two\nlines, "quoted"'] and ids == ["csv:2", "csv:3"]
    # the same through Spark's own reader of files, which passes over files without bytes
    other = verified_csv.parse_files(verified_csv.read_files(spark, folder))
    assert outcome(verified_csv.verified_statements(other)) == (statements, findings, {k: v for k, v in rejects.items() if k != "empty"}, quoted, ids)


def rows_of(name, n=2):
    return [Row(source_file=name, **{c: f"{c} {i}\n" if c == "description" else f"{i}" for c in COLUMNS}) for i in range(n)]


def test_a_write_shows_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(StatementCsv)
    out = tmp_path / "out"
    out.mkdir()
    rows = spark.createDataFrame([r for i in range(7) for r in rows_of(f"{i}.csv", 3)]).withColumn("seq", F.monotonically_increasing_id())
    dealt = rows.repartition(3, "source_file").sortWithinPartitions("source_file", "seq")
    dealt.write.format("statement_csv").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"{i}.csv" for i in range(7)]
    again = spark.read.format("statement_csv").load(str(out))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in again.collect()) == sorted(tuple(r[c] for c in COLUMNS) for r in rows.collect())
    with pytest.raises(Exception, match="plain name"):
        rows.withColumn("source_file", F.concat(F.lit("../"), "source_file")).write.format("statement_csv").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"{i}.csv" for i in range(7)]  # nothing is left of the job that failed
    dealt.where("source_file = '3.csv'").write.format("statement_csv").mode("overwrite").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["3.csv"]


def test_commit_and_abort(tmp_path):
    writer = StatementCsvWriter(str(tmp_path), False)
    one, two = writer.write(iter(rows_of("a.csv"))), writer.write(iter(rows_of("b.csv")))
    lost = writer.write(iter(rows_of("a.csv")))  # an attempt that doesn't count
    assert not list(tmp_path.glob("*.csv"))
    writer.commit([one, two, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "b.csv"]
    writer = StatementCsvWriter(str(tmp_path), True)
    writer.abort([writer.write(iter(rows_of("c.csv"))), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "b.csv"] and lost.files
    writer = StatementCsvWriter(str(tmp_path), True)
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([writer.write(iter(rows_of("c.csv"))), writer.write(iter(rows_of("c.csv")))])
    with pytest.raises(ValueError, match="come together"):
        writer.write(iter([*rows_of("d.csv"), *rows_of("e.csv"), *rows_of("d.csv")]))
    assert sorted(p.name for p in tmp_path.glob("*.csv")) == ["a.csv", "b.csv"]


def test_files_are_worked_out_where_they_were_dealt(spark, folder):
    """no result moves or parses records again, and files are written from Arrow batches."""
    parts = verified_csv.verified_statements(spark.read.format("statement_csv").load(folder))
    for df in parts:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Scan parquet" in plan and "regexp" not in plan, plan
    writer = StatementCsv({"path": folder}).writer(parts[0].sparkSession.createDataFrame([], statement_csv.SCHEMA).schema, False)
    assert isinstance(writer, DataSourceArrowWriter)


def test_amounts_as_most_are_printed_are_cast_as_they_stand(spark):
    texts = ["12.50", " -3 ", "0.00", "-0.00", "12.5", "9" * 16 + ".99", "9" * 17, "", " ", "12.", "1.234", "--1", "-1-", "+2", "3\n", "1,234.50", "(7.00)", "5.00 DR", None]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_money(F.col("t")).alias("m")).collect()]
    want = ["12.50", "-3.00", "0.00", "0.00", "12.50", "9" * 16 + ".99", None, None, None, None, None, None, None, "2.00", "3.00", "1234.50", "-7.00", "-5.00", None]
    assert [None if x is None else str(x) for x in got] == want
