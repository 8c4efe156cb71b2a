"""Gates, override and the decision run on a few hand-made cases."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from ledgerloom.operators import coverage, decision, ledger as rows_of, metrics
from ledgerloom.sources import verified_csv
from pyspark.sql import functions as F

LEDGER = ("case_id long, account_id string, stmt_id string, id long, seq int, date date, month string, tx_type string, amount decimal(18,2), description string, "
          "category string, revenue_status string, reviewed boolean, internal_transfer boolean, balance decimal(18,2), statement_period_start date")  # fmt: skip
STATEMENTS = ("case_id long, account_id string, stmt_id string, stmt_ord int, currency string, period_start date, period_end date, opening decimal(18,2), "
              "rate decimal(18,6), status string, extraction_method string")  # fmt: skip
CASES = ("case_id long, industry string, months_in_business int, public_records string, bank_verification string, credit_score int, extraction_confirmed boolean, "
         "pages_reviewed boolean, coverage_acknowledged boolean, integrity_reviewed boolean, integrity_note string, compared boolean, complete boolean, "
         "override_signature string, repayment_term int, repayment_factor decimal(6,4), advance_pct_revenue decimal(6,2)")  # fmt: skip
GOOD, BAD = decision.ALLOWED_STATUSES[0], "review_required"


def row(case, i, side, amount, text, status="True Revenue", category="True Revenue - POS / Processor"):
    d = date(2026, 1, 1) + timedelta(i % 90)
    return (case, f"a{case}", "s", i + 1000 * case, i, d, d.strftime("%Y-%m"), side, Decimal(amount), text, category, status, True, False, None, d.replace(day=1))


def case(number, **changed):
    base = dict(industry="5812 - Eating Places / Restaurants", months_in_business=60, public_records="Clean", bank_verification="Original PDF", credit_score=700,
                extraction_confirmed=True, pages_reviewed=True, coverage_acknowledged=True, integrity_reviewed=True, integrity_note="n", compared=True, complete=True,
                override_signature=None, repayment_term=None, repayment_factor=None, advance_pct_revenue=None)
    return (number, *(base | changed).values())


@pytest.fixture(scope="module")
def frames(spark):
    rows, months = [], [(date(2026, m, 1), date(2026, m, 28 if m == 2 else 31)) for m in (1, 2, 3)]
    for c in range(1, 8):
        amount = "100" if c == 2 else "9000"
        rows += [row(c, i, "credit", amount, "STRIPE PAYOUT") for i in range(0, 90, 5)]
        rows += [row(c, i, "debit", "50", "RENT" if c != 3 else "RENT PAST DUE", "Not Applicable", "Operating / Other Debit") for i in range(0, 90, 30)]
    rows.append(row(4, 7, "credit", "80", "ACME", "Review Required", "Review Required - Unidentified / Unusual Deposit"))
    statements = [(c, f"a{c}", f"s{c}/{m}", m, "CAD", a, b, Decimal(1000), Decimal(1), BAD if c in (5, 6) else GOOD, "text") for c in range(1, 8) for m, (a, b) in enumerate(months, 1)]
    ledger, st = spark.createDataFrame(rows, LEDGER), spark.createDataFrame(statements, STATEMENTS)
    signed = {r.case_id: r.signature for r in decision.data_signature(ledger, st).collect()}
    cases = [case(1), case(2), case(3), case(4), case(5), case(6, override_signature=signed[6], compared=False), case(7, override_signature=signed[6], complete=None)]
    chosen = coverage.coverage_summary(coverage.covered_days(st), coverage.offer_months(st))
    inputs = decision.underwriting_inputs(ledger, st, chosen)
    findings = st.where("case_id in (5, 6) and stmt_ord = 2").select("case_id", "stmt_id", F.lit("debits total does not match").alias("code"))
    cases = spark.createDataFrame(cases, CASES)
    return cases, inputs, decision.gate_findings(cases, ledger, st, findings, inputs), ledger, st


def test_gates_of_each_case(frames):
    got = {}
    for r in frames[2].collect():
        got.setdefault(r.case_id, set()).add(r.gate)
    assert got == {2: {"revenue_below_minimum"}, 3: {"hard_stop"}, 4: {"pending_deposits"}, 5: {"statement_issues", "disallowed_status"}, 7: {"completeness_unconfirmed"}}


def test_only_open_cases_get_a_range(frames):
    out = {r.case_id: r for r in decision.decision_run(frames[0], frames[1], frames[2]).collect()}
    assert {c for c, r in out.items() if r.blocked} == {2, 3, 4, 5, 7} and len(out) == 7
    assert all((out[c].low is None) == out[c].blocked and (out[c].score is None) == out[c].blocked for c in out)
    assert out[1].low < out[1].median < out[1].high and out[1].funding_position == 1 and out[1].term == 6 and out[6].high == out[1].high


def test_signature_names_the_data(frames):
    *_, ledger, st = frames
    a = {r.case_id: r.signature for r in decision.data_signature(ledger, st).collect()}
    b = {r.case_id: r.signature for r in decision.data_signature(ledger.repartition(7).orderBy(F.rand(1)), st).collect()}
    c = {r.case_id: r.signature for r in decision.data_signature(ledger.where("id <> 1000"), st).collect()}
    assert a == b and a[1] != c[1] and a[2] == c[2]


def test_a_transfer_names_its_other_account(spark):
    texts = [("bmo_business:1", "debit", "Transfer, 1234-5678-901 x"), ("scotia:1", "debit", "TRANSFER TO 12345 67890 12"), ("scotia:1", "credit", "TRANSFER TO 12345 67890 12"),
             ("vancity:1", "credit", "Funds Transfer - Online From # 10 555"), ("vancity:1", "credit", "Funds Transfer - Online From # 20 555"), ("td:1", "debit", "Transfer, 1234-5678-901")]
    df = spark.createDataFrame(texts, "account_id string, tx_type string, description string")
    got = [r.t for r in df.select(rows_of.transfer_target(F.col("account_id"), F.col("tx_type"), F.col("description")).alias("t")).collect()]
    assert got == ["bmo_business:12345678-901", "scotia:123456789012", None, "vancity:555", None, None]


def test_exports_have_names(spark, tmp_path, frames):
    written = verified_csv.write_exports({"ledger": frames[3], "advances": frames[0].select("case_id", F.array(F.lit(1)).alias("ids")), "decision_memo": frames[1]}, str(tmp_path))
    assert len(written) == 3 and spark.read.json(f"{tmp_path}/ledger").count() == frames[3].count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/advances").first().ids == "[1]"
    assert spark.read.json(f"{tmp_path}/decision_memo").count() == 7
    with pytest.raises(ValueError):
        verified_csv.write_exports({"other": frames[0]}, str(tmp_path))


def test_exports_of_many_cases_are_few_files(spark, tmp_path):
    """files grow with the rows, not with the cases; each row names its case, and those of a case are together."""
    rows = spark.range(3000).select((F.col("id") % 500).alias("case_id"), "id")
    paths = verified_csv.write_exports({"ledger": rows, "advances": rows, "decision_memo": rows.where("id < 500")}, str(tmp_path / "out"))
    assert all(1 <= len(list(tmp_path.glob(f"out/{p.rsplit('/', 1)[1]}/**/part-*"))) <= 4 for p in paths)
    ledger = spark.read.schema("case_id long, id long").json(paths[0])
    assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, rows.collect()))
    assert ledger.select("case_id", F.input_file_name()).distinct().count() == 500
    advances = spark.read.option("header", True).schema("case_id long, id long").csv(paths[1])
    assert sorted(map(tuple, advances.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.read.json(paths[2]).where("get_json_object(memo, '$.id') = case_id").count() == 500
    verified_csv.write_by_case(rows.where("case_id < 3"), str(tmp_path / "folders"), "json", folders=True)
    assert sorted(p.name for p in (tmp_path / "folders").glob("case_id=*")) == [f"case_id={i}" for i in range(3)]
    assert spark.read.json(str(tmp_path / "folders")).count() == 18


def test_first_names_keep_their_spelling(spark):
    names = spark.createDataFrame([(1, 2, "ACME INC"), (1, 1, "Acme Inc."), (1, 3, " ")], "case_id long, ord int, name string")
    assert [r.name for r in metrics.first_names(names).collect()] == ["Acme Inc."]
