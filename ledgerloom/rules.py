"""Policy constants of the ledger library. Patterns run over accent-free capitals and hold in Java and RE2 alike."""

from __future__ import annotations

TRUE, NON, REVIEW, NOT_APPLICABLE = "True Revenue", "Non-Revenue", "Review Required", "Not Applicable"

# ---- Fixed values: categories -----------------------------------------------------------------------------------------
TRUE_CATEGORY = "True Revenue - Verified Operating Receipts"
NON_CATEGORY = "Non-Revenue - Other / Verified Non-Revenue"
UNKNOWN = "Review Required - Unidentified / Unusual Deposit"
POS = "True Revenue - POS / Processor"
CUSTOMER = "True Revenue - Customer Payment / Cheque"
REFUND = "Non-Revenue - Refund / Reversal / NSF"
INTEREST = "Non-Revenue - Interest"
LOAN = "Non-Revenue - MCA / Loan Proceeds"
INTERNAL = "Non-Revenue - Own-Account / Internal Transfer"
GOVERNMENT = "Non-Revenue - Gov / Tax / Insurance Proceeds"
FINANCING = "Existing Financing Payment"
OPERATING = "Operating / Other Debit"

# ---- Fixed values: exclusions of deposits, in order, over normalised text: pattern, category, reason --------------------
# Patterns here and below stand as given; whole texts are patterns between ^ and $.
EXCLUSIONS = [
    (r"\b(?:ACCT BAL REBATE|ACCOUNT BALANCE REBATE|FEE REBATE)\b", REFUND, "Bank fee rebate, not a customer receipt."),
    (r"\b(INTEREST PAYMENT|CREDIT INTEREST|INTEREST CREDIT)\b", INTEREST, "Bank interest, rather than an operating receipt."),
    (r"^INT ADJUSTMENT$", INTEREST, "Bank interest, rather than an operating receipt."),
    (r"\b(NSF|REFUND|REVERSAL|REVERSED|CHARGEBACK|UNPAID|RETURNED|RETURN|CANCEL(?:LED)?|EXPIRED|EXPIRE|REMBOURSEMENT|RETOUR|REJETE)\b",
     REFUND, "Returned payment, refund, or reversal."),
    (r"\b(LOAN|FINANCING|FUNDING|SHAREHOLDER|OWNER CONTRIBUTION|ACTIONNAIRE|PRET)\b|\b(?:STRIPE|SQUARE) CAPITAL\b|\bSQ\s+SQ\s+CAP\d+\b",
     LOAN, "Financing or owner funds, rather than an operating receipt."),
    (r"\b(OWN ACCOUNT|INTERNAL TRANSFER|ONLINE TRANSFER|TRANSFER (FROM|TO) \**\d+|TFR[- ]?(FR|TO)\b|VIREMENT ENTRE COMPTES)\b", INTERNAL,
     "Explicit account transfer."),
    (r"^TRANSFER IN (?:DEMAND SWEEP|COVER ACCT)$", INTERNAL, "Explicit account transfer."),
]
#: The one transfer label that heads a processor settlement.
SETTLEMENT_TRANSFER = r"^TRANSFER FROM \d{5} \d{2} SQUARE CANADA \d+ PAYMENT$"

# ---- Fixed values: suggestion patterns ----------------------------------------------------------------------------------
INTERNAL_PATTERNS = [
    r"\bTF\s*\d{3,4}\s*#\s*\d{3,4}[\-#]\d{3,4}\b", r"\bONLINE\s+TRANSFER\b", r"\bINTERNAL\s+TRANSFER\b",
    r"\bBALANCE\s+ADJUSTMENT\b", r"\b\d{4}-\d{4}-\d{3,4}\s*1005\b",
]
GOVERNMENT_PATTERNS = [
    r"\bPROV[/\.]?\s*LOCAL\s+GVT\s+PAYMENT\b", r"\bPROVINCE\s+OF\b", r"\bCRA\b|\bCANADA\s+REVENUE\b|\bPAD\s+CCRA\b",
    r"\bGST\b|\bHST\b", r"\bEI\s+BENEFIT\b|\bSERVICE\s+CANADA\b",
]
REVERSAL_PATTERNS = [
    r"\bNSF\b", r"RETURNED\s+ITEM", r"\bITEM\s+RETURNED\b", r"\bUNPAID\b", r"DISHONOURED", r"FRAIS\s+EFFET\s+RET",
    r"\bREVERSE\b", r"\bRECLAIM\b",
]
POS_PATTERNS = [
    r"\b(STRIPE|SQUARE|MONERIS|CLOVER|ELAVON|SHOPIFY|PAYPAL|WORLDPAY|ADYEN)\b",
    r"\b(CARD|POS)\s*(SETTLEMENT|PAYOUT|DEPOSIT)\b", r"\b(SETTLEMENT|PAYOUT)\s*(FROM|BY)?\s*\b(VISA|MASTERCARD|AMEX)\b",
]
CUSTOMER_PATTERNS = [
    r"\bCUSTOMER\s+(PAYMENT|RECEIPT)\b", r"\bCLIENT(?:\s+PAYMENT|\s+PAIEMENT)\b", r"\bPAYMENT\s+(RECEIVED|FROM\s+CUSTOMER)\b",
    r"\bINVOICE\s*(PAYMENT|RECEIPT)\b", r"\bPAIEMENT\s+CLIENT\b",
]
MERCHANT_SERVICE = r"(?:\bMISC\s+PAYMENT\s+(?:DP|MRCH)\d+\b|\b(?:DP|MRCH)\d+\s+MSP\b)"
EXPLICIT_RECEIPT = (
    r"\b(PAIEMENT(?: DE)? CLIENT|REGLEMENT (?:DE )?FACTURE|REMISE (?:DE )?(?:VISA|MASTERCARD|MONERIS)|"
    r"(?:UBER(?: HOLDINGS)?|DOORDASH|SKIP(?:THEDISHES)?|TGTG) (?:PAYOUT|SETTLEMENT)|"
    r"(?:MISC\s+PAYMENT\s+)?(?:UBER HOLDINGS|SKIP(?: NA)?|TGTG)\b|MERCHANT SETTLEMENT)\b"
)
ETRANSFER, OUTGOING = r"\bE[ -]?TRANSFER\b|\bE[ -]?TFR\b", r"\bSEND|\bSENT|\bOUTGOING"

# ---- Fixed values: lenders and the names that statements print for them, in order of declaration --------------------------
PREMIUM_LENDERS = {
    "MERCHANT GROWTH": ["MERCHANT GROWTH", "MERCHPAD", "MERCH PAD"],
    "GREENBOX": ["GREENBOX", "GREEN BOX", "GREENBOX CAPITAL"],
    "VAULT": ["VAULT", "VAULT FINANCIAL"],
    "DRIVEN": ["DRIVEN", "DRIVEN CAPITAL"],
    "JOURNEY": ["JOURNEY", "JOURNEY CAPITAL", "JOURNEY FUNDING", "ONDECK"],
    "ICAPITAL": ["ICAPITAL", "I CAPITAL", "IPAPITAL"],
}
STANDARD_LENDERS = {
    "CANACAP": ["CANACAP", "CANA CAP", "CANA CAPITAL", "CANACAPITAL"],
    "2M7": ["2M7", "2M7 FINANCIAL", "URAL", "URAL CAPITAL"],
    "BIZFUND": ["BIZFUND", "BIZ FUND", "BIZ-FUND"],
    "XUPER": ["XUPER", "XUPER FUNDING", "XUPER CAPITAL"],
    "NEWCO": ["NEWCO", "NEWCO CAPITAL"],
    "SHEAVES": ["SHEAVES", "SHEAVES CAPITAL"],
    "CMCA": ["CMCA", "C.M.C.A.", "CANADIAN MERCHANT"],
    "B2B": ["B2B", "B2B CAPITAL", "B2B FUNDING"],
    "FORWARD FUNDING": ["FORWARD FUNDING", "FORWARDFUNDING"],
    "KM CAPITAL": ["2313833 ONTARIO", "2313833 ONTARIO INC", "KM CAPITAL"],
    "EFSA": ["EFSA", "EFSA CAPITAL"],
    "ROOK BRISTOL": ["ROOK BRISTOL"],
    "ELECT CAPITAL": ["ELECT CAPITAL"],
    "SHARP SHOOTER": ["SHARP SHOOTER FUNDING", "SSF"],
    "MFUND": ["MFUND"],
    "9341-8812 QUEBEC": ["9341-8812 QUE", "9341-8812 QUEBEC INC"],
    "NORTH FUNDING": ["NORTH FUNDING"],
    "BUSINESS CREDIT CAPITAL": ["BUSINESS CR", "BCC", "BUSINESS CREDIT CAPITAL"],
    "FLEX CAPITAL": ["FLEXCAPITALGROUP", "FLEX CAPITAL"],
    "ONTAP": ["ONTAP CAPITAL"],
    "CLARA": ["CLARA CAPITAL"],
    "FUNDFI": ["FUNDFI"],
    "ADVENTEX": ["ADVANTEX", "ADVANTEX MARKETING", "ADVANTEX DINING"],
    "CAPITAL ADVANCE": ["CAPITAL ADVANCE"],
    "SIMPLY": ["SIMPLY"],
    "CLARIO": ["CLARIO"],
    "BIZCAP": ["BIZCAP"],
    "KEEP BUS": ["KEEP BUS", "KEEP BUS/ENT"],
    "1048279 ONT": ["1048279 ONT", "1048279 ONT RLS/LOY"],
    "TOTAL CREDIT": ["TOTAL CREDIT"],
    "PEOPLES TRUST": ["PEOPLES TRUST"],
    "ACURA FINANCE": ["ACURA FINANCE"],
}
#: Lenders known by a pattern, tried before the names: pattern over description keys, tier, lender.
EXTRA_LENDERS = [
    (r"\bBANQUE (?:DE )?DEVELOPPEMENT DU CANAD(?:A)?\b", "Bank", "BDC"),
    (r"\bACCORD (?:EXPRESS|SB FINANCE)\b", "Unconfirmed", "Accord financing"),
    (r"\b2\s*M\s*7\s*FINANCIAL\s*SOL(?:UTIONS)?\b", "Standard", "2M7"),
    (r"\b(?:VLFC\s*)?ECONOLEASE\b", "Unconfirmed", "Econolease"),
]
#: Debits that are no payment of a debt, and creditors known by their payment label, in order. The fee exception keeps its
#: name in a group, put back by the caller: RE2 has no look-ahead.
NOT_A_PAYMENT = r"\b(NSF|RETURNED|REVERSAL|REVERSED|REFUND|CANCELLED|CANCELED|RETOUR|REJETE)\b"
FEE_LABEL, FEE_EXCEPTION = r"\b(FEE|FEES|FRAIS)\b", r"^DIRECT DEBIT FEES DUES (INFINITY LEASIN)"
FIRST_CREDITOR = (r"\bJIM\s*PATTISON\s*LS\b", "Unconfirmed", "Jim Pattison lease")
CREDITORS = [
    (r"\bMBFS(?:\s+AUTO)?\b", "Bank", "MBFS Auto"),
    (r"\bRBC\s*LOAN\s*PYMT\b", "Bank", "RBC loan"),
    (r"\bINFINITY\s*LEASIN(?:G)?\b", "Unconfirmed", "Infinity lease"),
]
SERVUS_INTEREST = ("servus:", "DEBIT INTEREST", "Bank", "Servus credit facility")
LATE_CREDITORS = [
    (r"SCOTIA BANK\s+SCOTIA LINE", "Bank", "Scotia Line"),
    (r"\bSUMMIT ACCEPTAN(?:CE)?\b", "Unconfirmed", "Summit Acceptan"),
    (r"\bLOAN\s+PAYMENT\b", "Unconfirmed", "Unidentified loan payment"),
    (r"^LOAN$", "Unconfirmed", "Unidentified loan payment"),
    (r"\b(?:TRANSFER TO CR CARD|(?:CREDIT|CRD) CARD LOC (?:PAY|PAYMENT))\b", "Unconfirmed", "Credit card / line of credit payment"),
    (r"\b(?:LEASE PAYMENT|PAIEMENT (?:DE )?PRET)\b", "Unconfirmed", "Unidentified loan or lease payment"),
]
CONTRACT = r"\b(?:CONTRACT|CONTRAT|LOAN|PRET|LEASE)\s+(?:(?:NO|NUMBER|NUMERO)\s+)?([A-Z]*\d[A-Z0-9]*)\b"
CARD_PAYMENT = "Credit card / line of credit payment"

# ---- Fixed values: industries, points and seasonality ---------------------------------------------------------------------
INDUSTRIES = {
    "0191 - General Farms, Primarily Crop": (4, 1),
    "0212 - Beef Cattle, Except Feedlots": (4, 3),
    "1521 - General Contractors—Single-Family Houses": (4, 2),
    "1522 - General Contractors—Residential Buildings, Other": (4, 2),
    "1542 - General Contractors—Nonresidential Buildings": (5, 3),
    "1611 - Highway and Street Construction": (5, 1),
    "1711 - Plumbing, Heating & Air-Conditioning": (7, 3),
    "1721 - Painting and Paper Hanging": (4, 1),
    "1731 - Electrical Work": (7, 3),
    "1741 - Masonry, Stonework, Tile Setting & Plastering": (5, 1),
    "1751 - Carpentry Work": (5, 2),
    "1761 - Roofing, Siding & Sheet Metal Work": (3, 1),
    "1771 - Concrete Work": (4, 1),
    "1794 - Excavation Work": (4, 1),
    "1799 - Special Trade Contractors, NEC": (5, 3),
    "2011 - Meat Packing Plants": (5, 5),
    "2051 - Bread and Other Bakery Products": (6, 6),
    "2431 - Millwork": (5, 3),
    "2511 - Wood Household Furniture": (5, 3),
    "2752 - Commercial Printing, Lithographic": (5, 5),
    "3441 - Fabricated Structural Metal": (5, 3),
    "4212 - Local Trucking Without Storage": (4, 3),
    "4213 - Trucking, Except Local": (4, 3),
    "4215 - Courier Services, Except by Air": (5, 5),
    "5013 - Motor Vehicle Supplies & New Parts—Wholesale": (6, 6),
    "5031 - Lumber, Plywood, Millwork & Wood Panels—Wholesale": (5, 3),
    "5045 - Computers & Peripheral Equipment and Software—Wholesale": (6, 6),
    "5211 - Lumber & Other Building Materials Dealers": (6, 3),
    "5251 - Hardware Stores": (7, 5),
    "5411 - Grocery Stores": (7, 6),
    "5461 - Retail Bakeries": (6, 5),
    "5511 - Motor Vehicle Dealers (New and Used)": (4, 3),
    "5521 - Motor Vehicle Dealers (Used Only)": (3, 3),
    "5531 - Auto and Home Supply Stores": (6, 6),
    "5541 - Gasoline Service Stations": (6, 6),
    "5611 - Men's and Boys' Clothing Stores": (5, 2),
    "5621 - Women's Clothing Stores": (5, 2),
    "5661 - Shoe Stores": (5, 3),
    "5712 - Furniture Stores": (4, 3),
    "5731 - Radio, Television & Consumer Electronics Stores": (4, 3),
    "5812 - Eating Places / Restaurants": (4, 2),
    "5813 - Drinking Places / Bars": (2, 1),
    "5912 - Drug Stores & Proprietary Stores": (7, 6),
    "5921 - Liquor Stores": (5, 3),
    "5999 - Miscellaneous Retail Stores, NEC": (4, 3),
    "6512 - Operators of Nonresidential Buildings": (6, 6),
    "6513 - Operators of Apartment Buildings": (7, 6),
    "7011 - Hotels & Motels": (4, 1),
    "7215 - Coin-Operated Laundries & Drycleaning": (7, 6),
    "7231 - Beauty Shops": (6, 3),
    "7241 - Barber Shops": (6, 5),
    "7311 - Advertising Agencies": (6, 5),
    "7349 - Building Cleaning & Maintenance Services, NEC": (7, 6),
    "7371 - Computer Programming Services": (7, 6),
    "7372 - Prepackaged Software": (7, 6),
    "7373 - Computer Integrated Systems Design": (7, 6),
    "7538 - General Automotive Repair Shops": (7, 5),
    "7542 - Carwashes": (6, 2),
    "7997 - Membership Sports & Recreation Clubs": (4, 2),
    "7999 - Amusement & Recreation Services, NEC": (3, 1),
    "8011 - Offices & Clinics of Doctors of Medicine": (8, 6),
    "8021 - Offices & Clinics of Dentists": (8, 6),
    "8041 - Offices & Clinics of Chiropractors": (7, 5),
    "8042 - Offices & Clinics of Optometrists": (7, 5),
    "8049 - Offices & Clinics of Health Practitioners, NEC": (7, 5),
    "8082 - Home Health Care Services": (7, 6),
    "8111 - Legal Services": (8, 6),
    "8721 - Accounting, Auditing & Bookkeeping Services": (8, 3),
    "8742 - Management Consulting Services": (7, 5),
    "8999 - Services, NEC": (4, 3),
}
#: Fixed value: what an advance is expected to be repaid by.
ADVANCE_FACTOR = "1.46"
