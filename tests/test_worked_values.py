"""Hand-computed values, and the operators that SQL doesn't express against sequential restatements."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from ledgerloom.functions import money, text
from ledgerloom.operators import batches, classify, coverage, debt, documents, ledger, metrics, policy
from ledgerloom.sources import verified_csv
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_money_cells(spark):
    cells = {"(1,234.56)": "-1234.56", "1 234,56-": "-1234.56", "2,000 DR": "-2000", "$3,800": "3800", "20": "20", "15.49OD": "-15.49", "12.3.4": None,
             "1.234,56": "1234.56", "-5": "-5", "--5": None, "(5": None, "5 CR": "5", "-5 CR": None, "": None, "abc": None, "1,5": "1.5", "1,234": "1234"}
    got = column(spark, list(cells), money.parse_money)
    assert got == [None if v is None else Decimal(v).quantize(Decimal("0.01")) for v in cells.values()]
    assert column(spark, ["12.345", "12.34", "NaN", "1e3", " 7 "], money.decimal_value) == [None, Decimal("12.34"), None, None, Decimal("7.00")]
    assert column(spark, ["2026-01-32", "2026-1-2", "2026-02-28"], money.strict_day) == [None, None, date(2026, 2, 28)]


def test_text_keys(spark):
    assert column(spark, ["Dépôt  chèque", None], text.normalized) == ["DEPOT CHEQUE", None]
    named = ["INTERAC e-Transfer 12345", "Virement Interac reçu", "DEPOSIT 12", "STRIPE PAYOUT", "ACME LTD DEPOSIT"]
    assert column(spark, named, text.is_generic) == [True, True, True, False, False]
    assert column(spark, ["ai:6615-5009909", "ai:12 34", " x:1 ", ""], text.account_key) == ["ai:5009909", "ai:1234", "x:1", None]
    assert column(spark, ["JJaann", "Jan"], text.single_glyphs) == ["Jan", "Jan"]
    assert column(spark, ["1234-5678 QUEBEC INC", "ACME 12", "ab"], text.searchable_company) == [False, True, False]


def test_classification(spark):
    credits = {"STRIPE CAPITAL": "Non-Revenue - MCA / Loan Proceeds", "STRIPE REFUND": "Non-Revenue - Refund / Reversal / NSF",
               "Moneris CHARGEBACK": "Non-Revenue - Refund / Reversal / NSF", "TRANSFER FROM 12345 12 SQUARE CANADA 77 PAYMENT": "True Revenue - POS / Processor",
               "TRANSFER FROM 123": "Non-Revenue - Own-Account / Internal Transfer", "GREEN BOX": "Non-Revenue - MCA / Loan Proceeds"}
    got = column(spark, list(credits), lambda c: classify.suggested_category(c, F.lit("credit")))
    assert got == list(credits.values())
    lenders = column(spark, ["KEEP BUS/ENT 1", "ural capital", "2 M 7 FINANCIAL SOL", "TRANSFER TO LOAN 88", "SIMPLYX"], classify.lender_match)
    assert [x and x.lender for x in lenders] == ["KEEP BUS", "2M7", "2M7", "Bank loan #88", None]
    debits = column(spark, ["DIRECT DEBIT FEES DUES INFINITY LEASIN", "BIZFUND FEE", "MBFS AUTO", "BIZFUND RETURNED"],
                    lambda c: classify.debt_match(c, F.lit("debit"), F.lit("a")))
    assert [x and x.lender for x in debits] == ["Infinity lease", None, "MBFS Auto", None]


def statements(spark, rows):
    return spark.createDataFrame([(1, "a", f"s{i}", i, a, b, Decimal(o), "CAD") for i, (a, b, o) in enumerate(rows)],
                                 "case_id long, account_id string, stmt_id string, stmt_ord int, period_start date, period_end date, opening decimal(18,2), currency string"
                                 ).withColumn("rate", F.lit(1).cast("decimal(18,6)"))


def test_daily_balances_skip_uncovered_days(spark):
    st = statements(spark, [(date(2026, 4, 1), date(2026, 4, 5), "0"), (date(2026, 4, 21), date(2026, 4, 25), "0")])
    rows = [(1, "a", date(2026, 4, 1), 1, "credit", Decimal(100), None), (1, "a", date(2026, 4, 21), 1, "credit", Decimal(200), None)]
    kind = "case_id long, account_id string, date date, seq int, tx_type string, amount decimal(18,2), statement_period_start date"
    got = coverage.daily_balances(st, spark.createDataFrame(rows, kind)).first()
    assert (got.average_daily_balance, got.covered_days, got.negative_days) == (150.0, 10, 0)
    quiet = statements(spark, [(date(2026, 1, 1), date(2026, 1, 31), "100")])
    one = spark.createDataFrame([(1, "a", date(2026, 1, 2), 1, "credit", Decimal(900), None)], kind)
    assert abs(coverage.daily_balances(quiet, one).first().average_daily_balance - 30100 / 31) < 1e-6
    bad = spark.createDataFrame([(1, "a", None, 1, "credit", Decimal(900), None)], kind)
    assert coverage.daily_balances(quiet, bad).count() == 0


def test_metrics_of_four_months(spark):
    sums = {"2026-01": "554417.20", "2026-02": "483431.45", "2026-03": "422695.88", "2026-04": "473380.70"}
    rows = spark.createDataFrame([(1, m, Decimal(v), "credit", "True Revenue", True, False, "p") for m, v in sums.items()],
                                 "case_id long, month string, amount decimal(18,2), tx_type string, revenue_status string, reviewed boolean, internal_transfer boolean, description string")
    months = spark.createDataFrame([(1, m, 1.0, True) for m in sums], "case_id long, month string, coverage_fraction double, complete boolean")
    got = metrics.revenue_metrics(rows, months).first()
    assert (round(got.average, 4), round(got.trend, 10), round(got.volatility, 10)) == (483481.3075, -14.6165198338, 9.7171969078)
    half = spark.createDataFrame([(1, "2026-01", 0.5, False)], months.schema)
    assert metrics.revenue_metrics(rows, half).first().trend is None


def test_months_runs(spark):
    run = lambda *m: sorted(r.month for r in coverage.latest_run(spark.createDataFrame([(1, x) for x in m], "case_id long, month string")).collect())
    assert run("2025-12", "2026-01", "2026-02", "2026-05", "2026-06") == ["2026-05", "2026-06"]
    assert run("2025-11", "2025-12", "2026-01") == ["2025-11", "2025-12", "2026-01"]


def test_continuity(spark):
    kind = "case_id long, account_id string, stmt_id string, stmt_ord int, period_start date, period_end date, opening decimal(18,2), closing decimal(18,2), currency string"
    make = lambda day: spark.createDataFrame([(1, "a", "x", 1, date(2026, 1, 1), date(2026, 1, 31), Decimal(0), Decimal(100), "CAD"),
                                              (1, "a", "y", 2, day, date(2026, 2, 28), Decimal(200), Decimal(200), "CAD")], kind)
    assert ledger.balance_continuity(make(date(2026, 2, 1))).count() == 1 and ledger.balance_continuity(make(date(2026, 2, 2))).count() == 0


def test_funding(spark):
    case = spark.createDataFrame([(1, "100000", "0.7", 6, 1, None), (2, "44872.19", "0.7", 6, 2, None), (3, "100000", "0.7", 6, 4, None), (4, "100000", "0.7", 5, 1, "50000.009")],
                                 "case_id long, revenue string, advance string, term int, funding_position int, cap string")
    zero = F.lit("0").cast("decimal(18,2)")
    got = {r.case_id: r for r in policy.funding_limits(case.select(
        "case_id", F.col("revenue").cast("decimal(18,2)").alias("revenue"), F.col("advance").cast("decimal(6,4)").alias("advance"), "term", "funding_position",
        F.col("cap").cast("decimal(18,3)").alias("cap"), zero.alias("monthly_debt"), zero.alias("operating_outflows"), zero.alias("reserve"),
        F.lit("1.46").cast("decimal(6,4)").alias("factor"), F.lit("0.15").cast("decimal(6,4)").alias("max_burden"))).collect()}
    assert got[1].amount == Decimal("70000.00") and abs(got[1].monthly_payment - 70000 * 1.46 / 6) < 1e-9 and got[2].amount == Decimal("31410.53")
    assert got[3].amount is None and got[3].problem == "term out of bounds" and got[4].amount == Decimal("50000.00") and got[4].binding == "product_cap"
    low, median, high = policy.estimate_range(F.lit("70000").cast("decimal(18,2)"))
    assert tuple(spark.range(1).select(low, median, high).first()) == (Decimal("59500.00"), Decimal("64750.00"), Decimal("70000.00"))


def test_advance_is_repaid_or_unknown(spark):
    kind = "case_id long, account_id string, currency string, id long, date date, tx_type string, amount decimal(18,2), description string"
    day = date(2026, 1, 1)
    gift, pay = (1, "a", "CAD", 1, day, "credit", Decimal(1000), "GREENBOX"), (1, "a", "CAD", 2, day + timedelta(9), "debit", Decimal(1460), "GREENBOX")
    back = (1, "a", "CAD", 3, day + timedelta(12), "credit", Decimal(1460), "ITEM RETURNED")
    first = lambda *rows: debt.advances(spark.createDataFrame(rows, kind)).orderBy("advance_id").first()
    assert first(gift, pay).remaining == 0 and first(gift, pay).status == "expected completed"
    assert first(gift, pay[:6] + (Decimal(460),) + pay[7:]).remaining == 1000
    assert first(gift, pay, back).remaining is None and first(gift, gift[:3] + (4,) + gift[4:], pay).remaining is None
    assert first(pay).status == "unknown: no funding deposit"


PAYMENTS = "case_id long, account_id string, lender string, reference string, date date, id long, amount decimal(18,2), seq long"


def streams_of(spark, *days):
    """The amounts of each stream, in order of date; days: the amounts paid on successive days."""
    paid = [(d, a) for d, amounts in enumerate(days) for a in amounts]
    rows = [(1, "a", "L", "", date(2026, 2, 1) + timedelta(d), i, Decimal(a), i) for i, (d, a) in enumerate(paid)]
    out = {}
    for r in debt.concurrent_streams(spark.createDataFrame(rows, PAYMENTS)).orderBy("date", "seq").collect():
        out.setdefault(r.stream, []).append(int(r.amount))
    return out


def test_payment_streams(spark):
    assert streams_of(spark, *[(174, 192)] * 6) == {1: [174] * 6, 2: [192] * 6}
    assert streams_of(spark, *[(192, 174)] * 6) == {1: [174] * 6, 2: [192] * 6}  # the order of a day's rows tells nothing
    assert streams_of(spark, *[(175,)] * 6, *[(192,)] * 6) == {1: [175] * 6 + [192] * 6}  # one payment that changed
    assert streams_of(spark, *[(174, 174)] * 6) == {1: [174] * 6, 2: [174] * 6}
    assert streams_of(spark, *[(100, 500)] * 2, *[(200, 510)] * 4) == {1: [100] * 2 + [200] * 4, 2: [500] * 2 + [510] * 4}
    assert streams_of(spark, (5, 99, 100), *[(100, 200)] * 5) == {1: [100] * 6, 2: [5, 99] + [200] * 5}  # the third of a day joins the nearest
    assert streams_of(spark, *[(100, 200)] * 2, *[(100,)] * 4) == {1: [100, 200, 100, 200] + [100] * 4}  # two of six days
    six = [(1, "b", "L", "", date(2026, 2, 1) + timedelta(i // 2), 1000 + i, Decimal((174, 192)[i % 2]), i) for i in range(12)]
    pattern = debt.payment_pattern(debt.concurrent_streams(spark.createDataFrame(six, PAYMENTS)), [*debt.GROUP, "stream"]).collect()
    assert sorted((r.installment, r.frequency) for r in pattern) == [(174, "Daily"), (192, "Daily")]


def test_payment_streams_lose_no_payment(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for g in range(30):
        for d in range(rng.randint(1, 9)):
            for _ in range(rng.choice([1, 2, 2, 2, 3])):
                rows.append((1, f"a{g}", "L", "", date(2026, 1, 1) + timedelta(d), at, Decimal(rng.randint(1, 6) * 50), at))
                at += 1
    rows += [(1, "undated", "L", "", None if i == 3 else date(2026, 1, 1 + i // 2), at + i, Decimal(7), at + i) for i in range(12)]
    out = debt.concurrent_streams(spark.createDataFrame(rows, PAYMENTS)).collect()
    assert sorted(r.id for r in out) == sorted(r[5] for r in rows)
    by_day = defaultdict(list)
    for r in out:
        by_day[r.account_id, r.date].append(r.stream)
    most = {g: max(s) for g, s in ((r.account_id, [x.stream for x in out if x.account_id == r.account_id]) for r in out)}
    for (g, _), streams in by_day.items():  # a day's payments share a stream only when each has one
        assert len(set(streams)) == min(len(streams), most[g]) or most[g] == 1
    assert most["undated"] == 1


def test_debt_rows_of_a_callers_matcher_and_cited_rows(spark):
    kind = "case_id long, account_id string, id long, date date, month string, tx_type string, amount decimal(18,2), description string, seq long"
    day = date(2026, 1, 5)
    rows = [(1, "a", 1, day, "2026-01", "debit", Decimal(10), "GREENBOX CAPITAL"), (1, "a", 2, day, "2026-01", "debit", Decimal(20), "ACME CO"),
            (1, "a", 3, day, "2026-01", "credit", Decimal(30), "ACME CO"), (1, "a", 4, day, "2026-01", "debit", Decimal(40), "RENT")]
    ledger = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], kind)
    own = lambda text: F.when(F.contains(text, F.lit("ACME")), F.struct(F.lit("Standard").alias("tier"), F.lit("ACME").alias("lender")))
    assert [(r.id, r.lender) for r in debt.debt_payments(ledger, own).collect()] == [(2, "ACME")]
    assert [r.lender for r in debt.seed_positions(ledger, own).collect()] == ["ACME"]
    assert debt.position_evidence(debt.seeded_payments(ledger)).count() == 1
    rows = debt.position_evidence(debt.seeded_payments(ledger)).groupBy("position_id").agg(F.collect_list(F.struct("id")).alias("evidence"))
    seeded = debt.seed_positions(ledger).join(rows, "position_id")
    cited = seeded.limit(1).withColumns({"position_id": F.lit("chat:x"), "contract": F.lit("chat:x"), "lender": F.lit("Landlord"),
                                         "evidence": F.transform("evidence", lambda e: e.withField("id", F.lit(4).cast("long")))})
    got = {r.id: r.lender for r in debt.debt_payment_rows(ledger, seeded.unionByName(cited)).collect()}
    assert got == {1: "GREENBOX", 4: "Landlord"}
    no = cited.withColumns({"verified": F.lit(True), "status": F.lit("Not debt")})
    assert {r.id for r in debt.debt_payment_rows(ledger, seeded.unionByName(no)).collect()} == {1}


def test_lines_of_words(spark):
    words = [(1, 1, "b", 50.0, 60.0, 11.0), (1, 1, "a", 10.0, 20.0, 10.0), (1, 1, "c", 10.0, 20.0, 13.5), (1, 1, "d", 10.0, 20.0, 17.0)]
    df = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, x1 double, top double")
    got = [r.text for r in documents.lines_of_words(df).orderBy("line").collect()]
    assert got == ["a b", "c", "d"]
    layout = spark.createDataFrame([("l", "date", 0.0, 30.0, "x0"), ("l", "debit", 30.0, 90.0, "x1")], "layout string, role string, lo double, hi double, edge string")
    cells = documents.cells(df.withColumn("layout", F.lit("l")).withColumn("line", F.lit(1)), layout).collect()
    assert {(c.role, c.text) for c in cells} == {("date", "a c d"), ("debit", "b")}


def test_document_pieces(spark):
    docs = spark.createDataFrame([(1, ["x"], None), (2, [], [("acc", 1)])], "doc_id long, issues array<string>, account_statements array<struct<account_id: string, n: int>>")
    out = batches.expand_documents(docs.withColumn("case_id", F.lit(1))).collect()
    assert sorted((r.doc_id, r.blocker) for r in out) == [(1, True), (2, False)]
    chars = [(1, 1, "4", 1.0, 2.0, 3.0), (1, 1, "9", 1.01, 2.0, 3.0), (2, 1, "5", 1.0, 2.0, 3.0)]
    flags = documents.integrity_flags(
        spark.createDataFrame([(1, "%%EOF /Prev 12 %%EOF", "Adobe Photoshop", "t"), (2, "%%EOF", None, " ")], "doc_id long, raw string, producer string, text string"),
        spark.createDataFrame(chars, "doc_id long, page int, text string, x0 double, top double, x1 double"),
    )
    assert sorted(map(tuple, flags.collect())) == [(1, "EDITING_SOFTWARE"), (1, "OVERLAPPING_DIGITS"), (1, "PDF_REVISIONS"), (2, "NO_TEXT_LAYER")]
    glyphs = [(1, 1, 1, c, float(i), 5.0, 9.0) for i, c in enumerate("12.50")] + [(1, 1, 1, "x", 0.0, 5.0, 7.0)]
    cell = documents.glyph_cells(spark.createDataFrame(glyphs, "doc_id long, page int, line int, text string, x0 double, top double, size double")).first()
    assert cell.cell == "12.50"


HEAD = "account_id,currency,period_start,period_end,opening_balance,closing_balance,expected_debits,expected_credits,date,description,debit,credit,balance"
META = "acct,CAD,2026-01-01,2026-01-31,100.00,130.00,20.00,50.00"


@pytest.fixture
def csvs(spark, tmp_path):
    good = f"{HEAD}\n{META},2026-01-02,SALE,,50.00,150.00\n{META},2026-01-03,RENT,20.00,,130.00\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "flawed.csv").write_text(good.replace(",130.00\n", ",131.00\n"))
    (tmp_path / "late.csv").write_text(good.replace("2026-01-03", "2026-02-03"))
    (tmp_path / "two.csv").write_text(good.replace("acct,CAD", "other,CAD", 1))
    return verified_csv.verified_statements(verified_csv.parse_files(verified_csv.read_files(spark, str(tmp_path))))


def test_verified_csv(spark, csvs, tmp_path):
    st, rows, findings, rejects = csvs
    name = lambda r: r.source_file.rsplit("/", 1)[1]
    assert sorted(map(name, rejects.collect())) == ["late.csv", "two.csv"]
    assert sorted(map(name, st.collect())) == ["flawed.csv", "good.csv"]
    assert sorted((name(r), r.code) for r in findings.collect()) == [("flawed.csv", "balance_mismatch"), ("flawed.csv", "closing_differs")]
    assert sorted((name(r), r.tx_type, r.amount) for r in rows.collect() if name(r) == "good.csv") == [("good.csv", "credit", 50), ("good.csv", "debit", 20)]
    out = rows.withColumn("case_id", F.lit(1))
    for kind in ("parquet", "json", "csv"):
        verified_csv.write_by_case(out, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() >= 4
    assert verified_csv.memo_rows(out).count() == 4


def test_glyphs_of_a_line_are_gathered_once(spark):
    """one shuffle; equal amounts count once, and missing sizes and positions are groups of their own."""
    kind, nan = "doc_id long, page int, line int, text string, x0 double, top double, size double", float("nan")
    put = lambda line, text, top, size: [(1, 1, line, c, float(i), top, size) for i, c in enumerate(text)]
    rows = [
        *put(1, "12.50", 5.0, 9.0), *put(1, "12.50", 7.0, 9.0), *put(2, "12.50", 5.0, 9.0), *put(2, "13.50", 7.0, 9.0), *put(3, "1.50", None, 9.0), *put(3, "x", nan, 9.0),
        *put(4, "$1,234.00", 5.04, 8.96), *put(4, "5x.00", 5.06, 9.0), *put(5, "1.5", 5.0, 9.0), *put(None, "7.00", -0.04, None), *put(7, "8.00", 0.25, 9.0), *put(7, "", 0.3, 9.0),
        (1, 1, 8, "9.0", 2.0, 0.25, 9.0), (1, 1, 8, "0", 3.0, 0.3, 9.0), (1, 1, 8, None, 4.0, 0.3, 9.0), *put(9, "2.00\n", 5.0, 9.0), *put(10, "٣.00", 5.0, 9.0),
    ]
    out = documents.glyph_cells(spark.createDataFrame(rows[::-1], kind).repartition(3))
    assert {r.line: r.cell for r in out.collect()} == {1: "12.50", 3: "1.50", 4: "$1,234.00", None: "7.00", 7: "8.00", 8: "9.00", 9: "2.00\n"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    x = [0.25, 0.35, -0.05, 0.05, 1e15 + 0.3, 123456.65, 2.05, -2.25, 7e8 + 0.004]
    tenths = spark.createDataFrame([(v,) for v in x], "v double").select(documents._tenth(F.col("v")).alias("a"), F.round("v", 1).alias("b")).collect()
    assert [r.a for r in tenths] == [r.b for r in tenths]
