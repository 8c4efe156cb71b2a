"""SQL views of the bridge ledger for the oracles, written apart from the Spark code: classifications of the 26 bridge
texts are worked out by hand."""

from __future__ import annotations

TEXTS = """
texts(side, k, txt, category, tier, lender, reference) AS (VALUES
    ('credit', 0, 'MONERIS SETTLEMENT 4471', 'True Revenue - POS / Processor', NULL, NULL, NULL),
    ('credit', 1, 'STRIPE PAYOUT', 'True Revenue - POS / Processor', NULL, NULL, NULL),
    ('credit', 2, 'STRIPE REFUND', 'Non-Revenue - Refund / Reversal / NSF', NULL, NULL, NULL),
    ('credit', 3, 'INTERAC e-Transfer Received', 'Review Required - Unidentified / Unusual Deposit', NULL, NULL, NULL),
    ('credit', 4, 'BUSINESS DEPOSIT', 'Review Required - Unidentified / Unusual Deposit', NULL, NULL, NULL),
    ('credit', 5, 'CUSTOMER PAYMENT INV 881', 'True Revenue - Customer Payment / Cheque', NULL, NULL, NULL),
    ('credit', 6, 'GREENBOX CAPITAL ADVANCE', 'Non-Revenue - MCA / Loan Proceeds', 'Premium', 'GREENBOX', NULL),
    ('credit', 7, 'GST REFUND CANADA REVENUE', 'Non-Revenue - Refund / Reversal / NSF', NULL, NULL, NULL),
    ('credit', 8, 'ONLINE TRANSFER', 'Non-Revenue - Own-Account / Internal Transfer', NULL, NULL, NULL),
    ('credit', 9, 'CREDIT INTEREST', 'Non-Revenue - Interest', NULL, NULL, NULL),
    ('credit', 10, 'Cheque returned NSF', 'Non-Revenue - Refund / Reversal / NSF', NULL, NULL, NULL),
    ('credit', 11, 'RETURNED ITEM CREDIT', 'Non-Revenue - Refund / Reversal / NSF', NULL, NULL, NULL),
    ('credit', 12, 'Virement Interac reçu', 'Review Required - Unidentified / Unusual Deposit', NULL, NULL, NULL),
    ('credit', 13, 'PAIEMENT CLIENT FACTURE 12', 'True Revenue - Customer Payment / Cheque', NULL, NULL, NULL),
    ('credit', 14, 'ACME PROPERTY 123', 'Review Required - Unidentified / Unusual Deposit', NULL, NULL, NULL),
    ('credit', 15, 'LOAN DISBURSEMENT', 'Non-Revenue - MCA / Loan Proceeds', NULL, NULL, NULL),
    ('debit', 0, 'RENT', 'Operating / Other Debit', NULL, NULL, NULL),
    ('debit', 1, 'GREENBOX CAPITAL PMT 10000017', 'Existing Financing Payment', 'Premium', 'GREENBOX', ''),
    ('debit', 2, 'BIZFUND PAYMENT TRACE', 'Existing Financing Payment', 'Standard', 'BIZFUND', ''),
    ('debit', 3, 'NSF item fee 3 @ $45.00', 'Non-Revenue - Refund / Reversal / NSF', NULL, NULL, NULL),
    ('debit', 4, 'NSF PAID FEE', 'Non-Revenue - Refund / Reversal / NSF', NULL, NULL, NULL),
    ('debit', 5, 'TRANSACTION SERVICE CHARGE', 'Operating / Other Debit', NULL, NULL, NULL),
    ('debit', 6, 'LEASE PAYMENT LEASE 88A', 'Existing Financing Payment', 'Unconfirmed', 'Unidentified loan or lease payment', 'LEASE PAYMENT LEASE 88A'),
    ('debit', 7, 'BDC LOAN', 'Existing Financing Payment', 'Bank', 'BDC', ''),
    ('debit', 8, 'PAYROLL', 'Operating / Other Debit', NULL, NULL, NULL),
    ('debit', 9, 'SUPPLIER INVOICE', 'Operating / Other Debit', NULL, NULL, NULL)
)"""

LEDGER = (
    TEXTS
    + """,
sided AS (
    SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS tx_type, CAST(o_orderdate AS DATE) AS day FROM orders
), plain AS (
    SELECT o_custkey // 500 * 5 + o_custkey % 5 AS case_id, o_custkey // 500 * 20 + o_custkey % 20 AS number, 'acct:' || number AS account_id,
        CASE WHEN o_custkey % 4 = 0 THEN 'USD' ELSE 'CAD' END AS currency, 'acct:' || number || ':' || strftime(day, '%Y-%m') AS stmt_id,
        year(day) * 12 + month(day) AS stmt_ord, o_orderkey AS id, day AS date, strftime(day, '%Y-%m') AS month, tx_type,
        CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        CAST(CASE WHEN tx_type = 'credit' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS move, o_orderkey
    FROM sided
), ledger AS (
    SELECT p.case_id, account_id, number, currency, stmt_id, stmt_ord, id, date, month, tx_type, amount, move, txt AS description, category, tier, lender, reference,
        CASE WHEN tx_type <> 'credit' THEN 'Not Applicable' WHEN category LIKE 'True Revenue%' THEN 'True Revenue'
             WHEN category LIKE 'Non-Revenue%' THEN 'Non-Revenue' ELSE 'Review Required' END AS revenue_status,
        row_number() OVER (PARTITION BY stmt_id ORDER BY date, id) AS seq,
        CAST(CASE WHEN id % 13 <> 0 THEN sum(move) OVER (PARTITION BY account_id ORDER BY date, id ROWS UNBOUNDED PRECEDING)
             + CASE WHEN id % 101 = 0 THEN 0.01 ELSE 0 END END AS DECIMAL(18,2)) AS balance
    FROM plain p JOIN texts t ON t.side = p.tx_type AND t.k = p.o_orderkey % CASE WHEN p.tx_type = 'credit' THEN 16 ELSE 10 END
), monthly AS (
    SELECT case_id, account_id, number, currency, stmt_id, stmt_ord, date_trunc('month', min(date))::DATE AS period_start,
        last_day(min(date)) AS month_end, sum(move) AS net, sum(amount) FILTER (WHERE tx_type = 'debit') AS d,
        sum(amount) FILTER (WHERE tx_type = 'credit') AS c FROM ledger GROUP BY ALL
), statements AS (
    SELECT case_id, account_id, currency, stmt_id, stmt_ord, period_start,
        CASE WHEN (stmt_ord + number) % 11 = 0 THEN period_start + 14 ELSE month_end END::DATE AS period_end,
        CAST(coalesce((SELECT sum(x.net) FROM monthly x WHERE x.account_id = m.account_id AND x.stmt_ord < m.stmt_ord), 0) AS DECIMAL(18,2)) AS opening,
        CAST(coalesce((SELECT sum(x.net) FROM monthly x WHERE x.account_id = m.account_id AND x.stmt_ord <= m.stmt_ord), 0) AS DECIMAL(18,2)) AS closing,
        CAST(coalesce(d, 0) AS DECIMAL(18,2)) AS debits, CAST(coalesce(c, 0) AS DECIMAL(18,2)) AS credits
    FROM monthly m WHERE (stmt_ord + number) % 7 <> 0
), days AS (
    SELECT DISTINCT case_id, account_id, unnest(generate_series(period_start, period_end, INTERVAL 1 DAY))::DATE AS day FROM statements
), accounts AS (
    SELECT case_id, count(DISTINCT account_id) AS n FROM statements GROUP BY case_id
), covered AS (
    SELECT d.case_id, d.day FROM days d JOIN accounts a ON a.case_id = d.case_id GROUP BY d.case_id, d.day, a.n HAVING count(*) = a.n
), coverage AS (
    SELECT case_id, strftime(day, '%Y-%m') AS month, count(*) AS covered_days, max(day(last_day(day))) AS calendar_days
    FROM covered GROUP BY 1, 2
)"""
)

EVENTS = (
    TEXTS
    + """,
raw AS (
    SELECT user_id % 50 AS case_id, user_id::VARCHAR AS account_id, CAST(ts AS DATE) AS date, ts, event_id AS id, event_type,
        CASE WHEN event_type IN ('purchase', 'error') THEN 'debit' ELSE 'credit' END AS tx_type, CAST(value AS DECIMAL(18,2)) AS amount
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), daily AS (
    SELECT r.*, txt AS description, category, tier, lender, reference, strftime(date, '%Y-%m') AS month,
        CASE WHEN tx_type = 'credit' THEN amount ELSE -amount END AS move
    FROM raw r JOIN texts t ON t.side = r.tx_type AND t.k = r.id % CASE WHEN r.tx_type = 'credit' THEN 16 ELSE 10 END
)"""
)


def over_orders(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{LEDGER.strip()}{sql}"


def over_events(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{EVENTS.strip()}{sql}"
