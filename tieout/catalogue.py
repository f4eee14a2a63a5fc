"""Formula catalogues, heading catalogues, taxonomies.

Everything here is data that results depend on; keep it literal and in natural order.
"""

# --- signed statement formulas: (formula, parent, children); '-' marks a negative term


BALANCE_RULES = [
    ("100", "100", ["110", "120", "130", "140", "150", "160"]),
    ("110", "110", ["111", "112"]),
    ("120", "120", ["121", "122", "123", "124", "125", "126"]),
    ("130", "130", ["131", "132", "133", "134", "135", "136", "137"]),
    ("140", "140", ["141", "142"]),
    ("150", "150", ["151", "152", "153"]),
    ("160", "160", ["161", "162", "163", "164", "165"]),
    ("200", "200", ["210", "220", "230", "240", "250", "260", "270"]),
    ("210", "210", ["211", "212", "213", "214", "215", "216"]),
    ("220", "220", ["221", "224", "227"]),
    ("221", "221", ["222", "223"]),
    ("224", "224", ["225", "226"]),
    ("227", "227", ["228", "229"]),
    ("230", "230", ["231", "236", "237", "238"]),
    ("231", "231", ["232", "233"]),
    ("233", "233", ["234", "235"]),
    ("240", "240", ["241", "242"]),
    ("250", "250", ["251", "252"]),
    ("260", "260", ["261", "262", "263", "264", "265", "266"]),
    ("270", "270", ["271", "272", "273", "274", "279"]),
    ("280", "280", ["100", "200"]),
    ("300", "300", ["310", "330"]),
    ("310", "310", [str(c) for c in range(311, 326)]),
    ("330", "330", [str(c) for c in range(331, 345)]),
    ("400", "400", ["411", "412", "413", "414", "415", "416", "417", "418", "419", "420", "429"]),
    ("411", "411", ["411A", "411B"]),
    ("420", "420", ["420A", "420B"]),
    ("440", "440", ["300", "400"]),
]

INCOME_RULES_BASELINE = [
    ("10", "10", ["01", "-02"]),
    ("20 from 10", "20", ["10", "-11"]),
    ("20 from 01", "20", ["01", "-02", "-11"]),
    ("30", "30", ["20", "21", "22", "-23", "-25", "-26", "27"]),
    ("40", "40", ["31", "-32"]),
    ("50", "50", ["30", "40"]),
    ("60 after tax", "60", ["50", "-51", "-52"]),
    ("60 by owner", "60", ["61", "62"]),
]

CASH_FLOW_RULES_BASELINE = [
    ("08", "08", ["01", "02", "03", "04", "05", "06", "07"]),
    ("18", "18", ["08", "09", "10", "11", "12", "13"]),
    ("20", "20", ["08", "09", "10", "11", "12", "13", "14", "15", "16", "17"]),
    ("30", "30", ["21", "22", "23", "24", "25", "26", "27"]),
    ("40", "40", ["31", "32", "33", "34", "35", "36"]),
    ("50", "50", ["20", "30", "40"]),
    ("70", "70", ["50", "60", "61"]),
]

CASH_FLOW_PROFILES = [
    ("08", "08", ["01", "02", "03", "04", "05", "06", "07"]),
    ("18", "18", ["14", "15", "16", "17"]),
    ("20", "20", ["08", "09", "10", "11", "12", "13", "14", "15", "16", "17"]),
    ("30", "30", ["21", "22", "23", "24", "25", "26", "27"]),
    ("40", "40", ["31", "32", "33", "34", "35", "36"]),
    ("50", "50", ["20", "30", "40"]),
    ("60", "60", ["50", "51", "52", "53", "54", "55", "56", "57"]),
    ("70", "70", ["60", "61"]),
]

BALANCE_IDENTITIES = [
    ("270 = 100 + 200", "270", ["100", "200"]),
    ("440 = 300 + 400", "440", ["300", "400"]),
    ("270 = 440", "270", ["440"]),
]

NEW_FORM_MARKERS = ["160", "161", "162", "163", "164", "165", "280", "325", "344"]
OLD_FORM_MARKERS = ["270", "410", "430", "440"]

SUBTOTAL_WORDS_CASH_FLOW = [
    "subtotal", "cash generated from operations", "total from operating",
    "tổng từ hoạt động kinh doanh",
]

# --- derived account facts: (key, source code, sign)
DERIVED_FACTS = [
    ("income tax", "51", 1),
    ("income tax", "52", 1),
    ("investments in other entities", "261", 1),
    ("investments in other entities", "262", 1),
    ("investments in other entities", "263", 1),
    ("net deferred tax", "272", 1),
    ("net deferred tax", "342", -1),
    ("accounts receivable combined", "131", 1),
    ("accounts receivable combined", "211", 1),
    ("accounts payable combined", "311", 1),
    ("accounts payable combined", "331", 1),
]


def signed_terms(rules) -> list[tuple]:
    """(formula, parent, child, sign, ord) rows of a rule list."""
    out = []
    for formula, parent, children in rules:
        for i, child in enumerate(children):
            negative = child.startswith("-")
            out.append((formula, parent, child.lstrip("-"), -1 if negative else 1, i))
    return out

# --- heading catalogues

TABLES_NEED_COLUMN_CHECK = [
    "acquisition of subsidiary",
    "changes in owners’ equity",
    "finance lease liabilities",
    "finance lease tangible fixed assets",
    "investment property held for capital appreciation",
    "investment property held to earn rental",
    "long-term borrowings, bonds and financial lease liabilities",
    "long-term deferred expenses",
    "long-term prepaid expenses",
    "long-term provisions",
    "mature livestock producing periodic products",
    "movement in temporary differences during the period",
    "movement in temporary differences during the year",
    "others payable to the state",
    "others payable to the state – long-term",
    "short-term borrowings, bonds and finance lease liabilities",
    "short-term provisions",
    "tangible fixed assets",
    "taxes and others payable to state treasury",
    "taxes and others payable to the state",
    "taxes and others payable to the state – long-term",
    "taxes and others receivable from state treasury",
    "taxes and others receivable from the state",
    "taxes payable to the state",
    "taxes payable to the state – long-term",
    "taxes receivable from state treasury",
    "taxes receivable from the state",
    "intangible fixed assets",
    "chi phí trả trước dài hạn",
    "tài sản cố định hữu hình",
    "tài sản cố định vô hình",
    "taxes payable to state treasury",
    "thuế và các khoản phải nộp nhà nước",
    "borrowings",
    "borrowings, bonds and finance lease liabilities",
    "short-term borrowings",
    "long-term borrowings",
]

TABLES_NEED_CHECK_SEPARATELY = [
    "finance lease tangible fixed assets",
    "goodwill",
    "investment property held for capital appreciation",
    "investment property held to earn rental",
    "mature livestock producing periodic products",
    "tangible fixed assets",
    "intangible fixed assets",
    "tài sản cố định hữu hình",
    "tài sản cố định vô hình",
]

TABLES_WITHOUT_TOTAL = [
    "business costs by element",
    "production and business costs by elements",
    "fair values versus carrying amounts",
    "fees paid and payable to the auditors",
    "geographical segments",
    "interest rate risk",
    "non-cash investing activity",
    "non-cash investing activities",
    "non-cash investing and financing activities",
    "significant transactions with related parties",
    "significant transactions with related companies",
    "corresponding figures",
    "transaction value",
    "annual interest rate",
    "equivalent vnd'000",
    "number of shares",
    "transfer from long-term borrowings",
    "recognised in consolidated balance sheet",
    "recognised in consolidated statement of income",
    "recognised in consolidated income statement",
]

# --- tie-outs of note totals to statement accounts, as data:
# (group, match, heading, slot, locator, account, sign, first use only)
# group M: more than one sub-total row, S: one. slot G: grand total, T1..T3: nth sub-total.
# locator: a word of the column header, or '' for the period columns. account '': the heading.

FORM_MAP = [
    ("M", "contains", "held-to-maturity investments", "T1", "cost", "123", 1, True),
    ("M", "contains", "held-to-maturity investments", "TL", "cost", "265", 1, True),
    ("M", "contains", "held-to-maturity investments", "T1", "allowance", "124", -1, True),
    ("M", "contains", "held-to-maturity investments", "TL", "allowance", "266", -1, True),
    ("M", "contains", "bad and doubtful debts", "TL", "allowance", "allowance for doubtful debts", -1, True),
    ("M", "contains", "recognised deferred tax", "G", "", "Net_DTA_DTL", 1, True),
    ("M", "exact", "receivables on construction contracts according to stages of completion", "G", "", "", 1, True),
    ("M", "exact", "payables on construction contracts according to stages of completion", "G", "", "", -1, True),
    ("M", "exact", "deferred tax assets and liabilities", "G", "", "", 1, True),
    ("M", "exact", "deferred tax assets", "G", "", "", 1, True),
    ("M", "exact", "deferred tax liabilities", "G", "", "", 1, True),
    ("M", "exact", "accounts payable to suppliers", "G", "", "", 1, True),
    ("M", "exact", "accrued expenses", "G", "", "", 1, True),
    ("M", "exact", "accrued expenses – short-term", "G", "", "accrued expenses", 1, True),
    ("M", "exact", "accrued expenses – long-term", "G", "", "long-term accrued expenses", 1, True),
    ("M", "exact", "deferred revenue", "G", "", "", 1, True),
    ("M", "exact", "deferred revenue – long-term", "G", "", "long-term deferred revenue", 1, True),
    ("M", "exact", "other payables", "G", "", "", 1, True),
    ("M", "exact", "long-term borrowings", "G", "carrying", "", 1, True),
    ("M", "exact", "long-term bonds", "G", "carrying", "", 1, True),
    ("M", "exact", "cash", "T1", "", "", 1, True),
    ("M", "exact", "cash and cash equivalents", "T1", "", "", 1, True),
    ("M", "exact", "cash in banks", "T1", "", "", 1, True),
    ("M", "exact", "biological assets – short-term", "T1", "cost", "151", 1, True),
    ("M", "exact", "biological assets – short-term", "T2", "cost", "152", 1, True),
    ("M", "exact", "biological assets – short-term", "G", "allowance", "153", 1, True),
    ("M", "contains", "revenue from", "T1", "", "", 1, True),
    ("M", "contains", "revenue from", "T2", "", "revenue deductions", -1, True),
    ("M", "contains", "revenue from", "G", "", "10", 1, True),
    ("M", "contains", "provisions", "G", "", "provisions", 1, True),
    ("S", "exact", "accounts payable to suppliers classified by payment terms", "T1", "", "accounts payable to suppliers", 1, True),
    ("S", "contains", "sales or disposals of investment", "T1", "", "21", 1, True),
    ("S", "contains", "general and administration", "T1", "", "26", 1, True),
    ("S", "exact", "trading securities", "T1", "cost", "", 1, True),
    ("S", "exact", "trading securities", "T1", "allowance", "allowance for diminution in the value of trading securities", -1, True),
    ("S", "contains", "held-to-maturity investments", "T1", "cost", "123", 1, True),
    ("S", "contains", "held-to-maturity investments", "T1", "allowance", "124", -1, True),
    ("S", "exact", "equity investments in other entities", "T1", "cost", "investments in other entities", 1, False),
    ("S", "exact", "equity investments in other entities", "T1", "carrying amounts", "investments in other entities", 1, False),
    ("S", "exact", "equity investments in other entities", "T1", "allowance", "264", -1, False),
    ("S", "exact", "bad and doubtful debts", "T1", "allowance", "allowance for doubtful debts", -1, True),
    ("S", "exact", "inventories", "T1", "cost", "141", 1, True),
    ("S", "exact", "inventories", "T1", "allowance", "142", 1, True),
    ("S", "exact", "biological assets – short-term", "T1", "cost", "151", 1, True),
    ("S", "exact", "biological assets – short-term", "T1", "allowance", "153", 1, True),
    ("S", "exact", "construction in progress", "G", "", "", 1, True),
    ("S", "exact", "long-term deferred expenses", "G", "", "", 1, True),
    ("S", "exact", "long-term work in progress", "T1", "cost", "", 1, True),
    ("S", "contains", "accounts payable to suppliers", "T1", "cost", "accounts payable to suppliers", 1, True),
    ("S", "contains", "taxes", "T1", "", "", 1, True),
    ("S", "exact", "short-term borrowings", "T1", "carrying", "", 1, True),
    ("S", "exact", "short-term bonds", "T1", "carrying", "", 1, True),
    ("S", "contains", "provisions", "G", "", "provisions", 1, True),
]

# Locators whose current and prior columns are read the other way round.
SWAPPED_LOCATORS = ["carrying"]
BORROWING_WORDS = ["borrowings", "bonds"]

SECTION_WHITELIST = [
    ("tài sản cố định hữu hình", "hữu hình"),
    ("tài sản cố định vô hình", "vô hình"),
    ("bất động sản đầu tư", "bất động sản"),
    ("chi phí trả trước dài hạn", "dài hạn"),
    ("chi phí trả trước ngắn hạn", "ngắn hạn"),
    ("doanh thu chưa thực hiện dài hạn", "dài hạn"),
    ("doanh thu chưa thực hiện ngắn hạn", "ngắn hạn"),
]

FIXED_ASSET_CODES = [
    ("tangible fixed assets", "222", "223"),
    ("finance lease tangible fixed assets", "225", "226"),
    ("intangible fixed assets", "228", "229"),
    ("mature livestock producing periodic products", "234", "235"),
    ("investment property held to earn rental", "241", "242"),
]

# Headings of notes that are tied out to the statements, by form.
FORM_1 = [
    "accounts receivable from customers", "accounts receivable from customers detailed by significant customer",
    "accounts receivable from customers detailed by significant customers", "receivables on construction contracts according to stages of completion",
    "payables on construction contracts according to stages of completion", "deferred tax assets and liabilities", "deferred tax assets",
    "deferred tax liabilities", "accrued expenses", "accrued expenses – short-term", "accrued expenses - short-term", "accrued expenses – long-term",
    "accrued expenses - long-term", "unearned revenue", "unearned revenue – short-term", "unearned revenue – long-term", "other payables",
    "other payables – short-term", "other payables – long-term", "long-term borrowings", "long-term borrowings, bonds and financial lease liabilities",
    "long-term bonds and financial lease liabilities", "long-term financial lease liabilities", "long-term bonds",
]
FORM_1A = [
    "receivables on construction contracts according to stages of completion", "payables on construction contracts according to stages of completion",
    "deferred tax assets and liabilities", "deferred tax assets", "deferred tax liabilities", "recognised deferred tax assets and liabilities",
    "accounts payable to suppliers", "accounts payable to suppliers detailed by significant suppliers",
    "accounts payable to suppliers detailed by significant supplier", "accounts payable to suppliers classified by payment terms", "accrued expenses",
    "accrued expenses – short-term", "accrued expenses - short-term", "accrued expenses – long-term", "accrued expenses - long-term",
    "deferred revenue", "deferred revenue – short-term", "deferred revenue – long-term", "long-term deferred revenue", "other payables",
    "other payables – short-term", "other payables – long-term", "long-term borrowings", "long-term bonds and financial lease liabilities",
    "long-term financial lease liabilities", "long-term bonds",
]
FORM_1B = ["cash", "cash and cash equivalents", "cash in banks"]
FORM_2 = [
    "biological assets – long-term, other than mature livestock producing periodic products", "biological assets – short-term",
    "revenue from sales of goods and provision of services", "revenue from sales of goods", "revenue from provision of services",
]
FORM_3 = [
    "acquisition of subsidiary", "business segments", "investments", "trading securities", "held-to-maturity investments",
    "equity investments in other entities", "equity investments in other entity", "bad and doubtful debts", "shortage of assets awaiting resolution",
    "inventories", "long-term work in progress", "construction in progress",
    "biological assets – long-term, other than mature livestock producing periodic products", "biological assets – short-term",
    "accounts receivable from customers", "accounts receivable from customers detailed by significant customer",
    "accounts receivable from customers detailed by significant customers", "accounts receivable from customers classified by payment term",
    "other short-term receivables comprised:", "other long-term receivables comprised:", "other receivables", "other short-term receivables",
    "other long-term receivables", "receivables from bcc contracts under joint control", "long-term prepaid expenses", "long-term deferred expenses",
    "investment property held for capital appreciation", "accounts payable to suppliers",
    "accounts payable to suppliers detailed by significant suppliers", "accounts payable to suppliers detailed by significant supplier",
    "taxes and others payable to state treasury", "taxes and others receivable from state treasury",
    "taxes and others receivable from and payable to state treasury", "taxes receivable from state treasury", "taxes payable to state treasury",
    "taxes and others receivable from the state", "taxes receivable from the state", "taxes and others payable to the state",
    "taxes payable to the state", "others payable to the state", "taxes and others payable to the state – long-term",
    "taxes payable to the state – long-term", "others payable to the state – long-term", "short-term borrowings",
    "short-term borrowings, bonds and finance lease liabilities", "short-term bonds and finance lease liabilities", "short-term bonds",
    "convertible bonds", "preference shares", "provisions", "short-term provisions", "long-term provisions", "changes in owners’ equity",
    "share capital", "contributed capital",
]
FORMS = [("1", FORM_1), ("1A", FORM_1A), ("1B", FORM_1B), ("2", FORM_2), ("3", FORM_3)]

# --- tie-outs that start from note cells -------------------------------------------
# Terms of headings without a total-only check; words of rows and columns that notes are read by.
RELATED_PARTY_TERMS = ["related parties", "related party", "related companies", "related company"]
COLUMN_WORDS = ["cost", "allowance", "carrying", "carrying amount", "carrying amounts", "quantity"]
EQUITY_ACCOUNTS = [
    ("contributed capital", "411"), ("share capital", "411"), ("capital surplus", "412"), ("share premium", "412"), ("convertible bonds", "413"),
    ("other capital", "414"), ("own shares", "415"), ("revaluation", "416"), ("exchange differences", "417"), ("investment", "418"),
    ("developement", "418"), ("other equity funds", "419"), ("retained profits", "420"), ("accumulated losses", "420"), ("non-controlling interest", "429"),
]

# The branch a note takes, first match first: (branch, groups, match, words). M: several sub-totals, S: one or
# none, Z: no figure above the total row. match exact or any: one of the words; all: every word; form: a list of FORMS, with all words.
NOTE_BRANCHES = [
    ("total only", "Z", "any", [""]),
    ("m held to maturity", "M", "any", ["held-to-maturity investments"]),
    ("m bcc", "M", "any", ["other parties under bcc contracts"]),
    ("m equity", "M", "any", ["changes in owners’ equity"]),
    ("m capital", "M", "any", ["share capital", "business segments"]),
    ("m convertible", "M", "any", ["convertible bonds"]),
    ("m preference", "M", "any", ["preference shares"]),
    ("m straight bonds", "M", "any", ["straight bonds and bonds convertible to a variable number of shares"]),
    ("m bad debts", "M", "any", ["bad and doubtful debts"]),
    ("m deferred tax", "M", "form 1A", ["recognised deferred tax"]),
    ("m contracts payable", "M", "form 1A", ["payables on construction contracts"]),
    ("m contracts receivable", "M", "form 1A", ["construction contracts"]),
    ("m accrued short", "M", "exact", ["accrued expenses – short-term"]),
    ("m accrued long", "M", "exact", ["accrued expenses – long-term"]),
    ("m deferred revenue long", "M", "exact", ["deferred revenue – long-term"]),
    ("m grand total", "M", "form 1A", [""]),
    ("m first sub-total", "M", "form 1B", [""]),
    ("m biological short", "M", "exact", ["biological assets – short-term"]),
    ("m biological long", "M", "form 2", ["biological assets – long-term"]),
    ("m revenue", "M", "form 2", [""]),
    ("m receivables by customer", "M", "all", ["accounts receivable from customers", "by significant customer"]),
    ("m borrowings long", "M", "any", ["long-term borrowing", "long-term bond"]),
    ("m provisions long", "M", "exact", ["long-term provisions"]),
    ("m provisions short", "M", "any", ["provisions"]),
    ("m other", "M", "any", [""]),
    ("s acquisition", "S", "form 3", ["acquisition of subsidiary"]),
    ("s trading", "S", "exact", ["trading securities"]),
    ("s held to maturity", "S", "form 3", ["held-to-maturity investments"]),
    ("s other entities", "S", "exact", ["equity investments in other entity", "equity investments in other entities"]),
    ("s receivables by customer", "S", "form 3", ["accounts receivable from customers", "by significant customer"]),
    ("s receivables by term", "S", "form 3", ["accounts receivable from customers", "by payment term"]),
    ("s other receivables long", "S", "form 3", ["other", "receivables", "long-term"]),
    ("s other receivables", "S", "form 3", ["other", "receivables"]),
    ("s bad debts", "S", "exact", ["bad and doubtful debts"]),
    ("s shortage", "S", "exact", ["shortage of assets awaiting resolution"]),
    ("s inventories", "S", "exact", ["inventories"]),
    ("s biological short", "S", "exact", ["biological assets – short-term"]),
    ("s biological long", "S", "form 3", ["biological assets – long-term"]),
    ("s construction", "S", "exact", ["construction in progress"]),
    ("s movement", "S", "exact", ["investment property held for capital appreciation", "long-term deferred expenses"]),
    ("s work in progress", "S", "exact", ["long-term work in progress"]),
    ("s payables", "S", "form 3", ["accounts payable to suppliers"]),
    ("s taxes", "S", "form 3", ["taxes"]),
    ("s borrowings short", "S", "form 3", ["short-term borrowing"]),
    ("s bonds short", "S", "form 3", ["short-term bond"]),
    ("s provisions long", "S", "exact", ["long-term provisions"]),
    ("s provisions short", "S", "form 3", ["provisions"]),
    ("s none", "S", "form 3", [""]),
    ("s payables by supplier", "S", "all", ["accounts payable to suppliers", "by significant"]),
    ("s payables by term", "S", "all", ["accounts payable to suppliers", "by payment"]),
    ("s accrued short", "S", "exact", ["accrued expenses – short-term"]),
    ("s accrued long", "S", "exact", ["accrued expenses – long-term"]),
    ("s deferred revenue long", "S", "exact", ["deferred revenue – long-term"]),
    ("s disposals", "S", "any", ["sales or disposals of investment"]),
    ("s administration", "S", "any", ["general and administration"]),
    ("s standard", "S", "any", [""]),
]

_SHORT_AR, _LONG_AR = "accounts receivable from customers", "accounts receivable from customers – long-term"
_SHORT_AP, _LONG_AP = "accounts payable to suppliers", "long-term accounts payable to suppliers"
_SHORT_BAD, _LONG_BAD = "allowance for doubtful debts", "allowance for doubtful long-term debts"
_ONE_TIME, _SEASONAL = "livestock producing one-time products – long-term", "seasonal crops or plants producing one-time products – long-term"
_IMPAIRED = "allowance for impairment of biological assets – long-term"

# What a branch ties out: (branch, choice, rank, test, need, lack, mark, row, column, account, sign, once).
# Of one choice, the first row applies whose test holds, whose account `need` has a fact as of the note, whose account
# `lack` has none, and whose account `mark` (+ or -) was checked before or not. account '': the heading.
TIE_OUT_PLAN = [
    ("total only", 1, 1, "", "", "", "", "total", "period", "", 1, True),
    ("m held to maturity", 1, 1, "", "", "", "", "T1", "cost", "123", 1, True),
    ("m held to maturity", 2, 1, "", "", "", "", "TL", "cost", "265", 1, True),
    ("m held to maturity", 3, 1, "", "", "", "", "T1", "allowance", "124", -1, True),
    ("m held to maturity", 4, 1, "", "", "", "", "TL", "allowance", "266", -1, True),
    ("m convertible", 1, 1, "", "", "", "", "after|T1", "last but one", "", 1, False),
    ("m preference", 1, 1, "", "", "", "", "after|T1", "last", "", 1, False),
    ("m bad debts", 1, 1, "short priced", "", "", "", "short", "allowance", _SHORT_BAD, -1, False),
    ("m bad debts", 1, 2, "short", "", "", "", "short", "period", _SHORT_BAD, 1, False),
    ("m bad debts", 1, 3, "priced", "", _LONG_BAD, "", "TL", "allowance", _SHORT_BAD, -1, False),
    ("m bad debts", 1, 4, "", "", _LONG_BAD, "", "TL", "period", _SHORT_BAD, 1, False),
    ("m bad debts", 2, 1, "long priced", "", "", "", "long", "allowance", _LONG_BAD, -1, False),
    ("m bad debts", 2, 2, "long", "", "", "", "long", "period", _LONG_BAD, 1, False),
    ("m bad debts", 2, 3, "priced", "", _SHORT_BAD, "", "TL", "allowance", _LONG_BAD, -1, False),
    ("m bad debts", 2, 4, "", "", _SHORT_BAD, "", "TL", "period", _LONG_BAD, 1, False),
    ("m deferred tax", 1, 1, "", "", "", "", "G", "period", "Net_DTA_DTL", 1, True),
    ("m deferred tax", 2, 1, "rows left", "", "", "", "long-term assets", "period", "deferred tax assets", 1, True),
    ("m deferred tax", 3, 1, "rows left", "", "", "", "long-term liabilities", "period", "deferred tax liabilities", -1, True),
    ("m contracts payable", 1, 1, "", "", "", "", "G", "period", "", -1, True),
    ("m contracts receivable", 1, 1, "", "", "", "", "G", "period", "", 1, True),
    ("m accrued short", 1, 1, "", "", "", "", "G", "period", "accrued expenses", 1, True),
    ("m accrued long", 1, 1, "", "", "", "", "G", "period", "long-term accrued expenses", 1, True),
    ("m deferred revenue long", 1, 1, "", "", "", "", "G", "period", "long-term deferred revenue", 1, True),
    ("m grand total", 1, 1, "", "", "", "", "G", "period", "", 1, True),
    ("m first sub-total", 1, 1, "", "", "", "", "T1", "period", "", 1, True),
    ("m biological short", 1, 1, "", "", "", "", "T1", "cost", "151", 1, True),
    ("m biological short", 2, 1, "", "", "", "", "T2", "cost", "152", 1, True),
    ("m biological short", 3, 1, "", "", "", "", "G", "allowance", "153", 1, True),
    ("m biological long", 1, 1, "", _ONE_TIME, "", "", "T1", "cost", _ONE_TIME, 1, True),
    ("m biological long", 2, 1, "two or three", _SEASONAL, "", "", "TP", "cost", _SEASONAL, 1, True),
    ("m biological long", 3, 1, "two or three", "immature livestock producing periodic products", "", "", "TL", "cost", "immature livestock producing periodic products", 1, True),
    ("m biological long", 4, 1, "", "", "", "", "G", "allowance", _IMPAIRED, 1, True),
    ("m revenue", 1, 1, "", "", "", "", "T1", "period", "", 1, True),
    ("m revenue", 2, 1, "", "", "", "", "T2", "period", "revenue deductions", -1, True),
    ("m revenue", 3, 1, "", "", "", "", "G", "period", "10", 1, True),
    ("m receivables by customer", 1, 1, "", "", _LONG_AR, "", "G", "carrying amount", _SHORT_AR, 1, True),
    ("m receivables by customer", 1, 2, "", "", _SHORT_AR, "", "G", "carrying amount", _LONG_AR, 1, True),
    ("m receivables by customer", 1, 3, "", "", "", "", "G", "carrying amount", "accounts receivable from customers-combined", 1, True),
    ("m borrowings long", 1, 1, "", "", "", "", "G", "carrying", "", 1, True),
    ("m provisions long", 1, 1, "", "", "", "", "G|opening", "last", "provisions – long-term", 1, True),
    ("m provisions short", 1, 1, "", "", "", "", "G|opening", "last", "provisions – short-term", 1, True),
    ("s trading", 1, 1, "", "", "", "", "T1", "cost", "", 1, True),
    ("s trading", 2, 1, "", "", "", "", "T1", "allowance", "allowance for diminution in the value of trading securities", -1, True),
    ("s held to maturity", 1, 1, "any short", "", "", "", "T1", "cost", "123", 1, True),
    ("s held to maturity", 1, 2, "", "", "", "", "T1", "cost", "265", 1, True),
    ("s held to maturity", 2, 1, "any short", "", "", "", "T1", "allowance", "124", -1, True),
    ("s held to maturity", 2, 2, "", "", "", "", "T1", "allowance", "266", -1, True),
    ("s other entities", 1, 1, "", "", "", "", "T1", "cost", "investments in other entities", 1, False),
    ("s other entities", 2, 1, "", "", "", "", "T1", "carrying amounts", "investments in other entities", 1, False),
    ("s other entities", 3, 1, "", "", "", "", "T1", "allowance", "264", -1, False),
    ("s receivables by customer", 1, 1, "", "", _LONG_AR, "", "T1", "carrying amount", _SHORT_AR, 1, True),
    ("s receivables by customer", 1, 2, "", "", _SHORT_AR, "", "T1", "carrying amount", _LONG_AR, 1, True),
    ("s receivables by customer", 1, 3, "", "", "", "", "T1", "carrying amount", "accounts receivable from customers-combined", 1, True),
    ("s receivables by term", 1, 1, "", "", "", "", "short or first", "carrying amount", _SHORT_AR, 1, True),
    ("s receivables by term", 2, 1, "", "", "", "", "long or first", "carrying amount", _LONG_AR, 1, True),
    ("s other receivables long", 1, 1, "", "", "", "", "T1", "carrying amount", "other long-term receivables", 1, True),
    ("s other receivables", 1, 1, "", "", "", "+other short-term receivables", "T1", "carrying amount", "other short-term receivables", 1, True),
    ("s other receivables", 1, 2, "", "", "", "", "T1", "carrying amount", "other receivables", 1, True),
    ("s bad debts", 1, 1, "", "", "", "", "T1", "allowance", _SHORT_BAD, -1, True),
    ("s shortage", 1, 1, "", "", "", "", "T1", "quantity", "", 1, True),
    ("s inventories", 1, 1, "", "", "", "", "T1", "cost", "141", 1, True),
    ("s inventories", 2, 1, "", "", "", "-142", "T1", "allowance", "142", 1, True),
    ("s inventories", 2, 2, "", "", "", "", "G|opening", "second", "142", 1, False),
    ("s biological short", 1, 1, "", "151", "", "", "T1", "cost", "151", 1, True),
    ("s biological short", 1, 2, "", "", "", "", "T1", "cost", "152", 1, True),
    ("s biological short", 2, 1, "", "", "", "", "T1", "allowance", "153", 1, True),
    ("s biological long", 1, 1, "", _ONE_TIME, "", "", "T1", "cost", _ONE_TIME, 1, True),
    ("s biological long", 1, 2, "", _SEASONAL, "", "", "T1", "cost", _SEASONAL, 1, True),
    ("s biological long", 1, 3, "", "", "", "", "T1", "cost", "mmature livestock producing periodic products", 1, True),
    ("s biological long", 2, 1, "", "", "", "", "T1", "allowance", _IMPAIRED, 1, True),
    ("s construction", 1, 1, "", "", "", "", "G|opening", "second", "", 1, True),
    ("s movement", 1, 1, "", "", "", "", "G|opening", "last", "", 1, True),
    ("s work in progress", 1, 1, "", "", "", "", "T1", "cost", "", 1, True),
    ("s payables", 1, 1, "", "", "", "", "T1", "cost", _SHORT_AP, 1, True),
    ("s taxes", 1, 1, "split", "", "", "", "within", "taxes", "", 1, True),
    ("s taxes", 1, 2, "unsplit", "", "", "", "T1", "taxes", "", 1, True),
    ("s taxes", 2, 1, "split", "", "", "", "after", "taxes", "* – long-term", 1, True),
    ("s borrowings short", 1, 1, "", "", "", "", "T1", "carrying", "", 1, True),
    ("s bonds short", 1, 1, "", "", "", "", "T1", "carrying", "", 1, True),
    ("s provisions long", 1, 1, "", "", "", "", "G|opening", "last", "provisions – long-term", 1, True),
    ("s provisions short", 1, 1, "", "", "", "", "G|opening", "last", "provisions – short-term", 1, True),
    ("s payables by supplier", 1, 1, "", "", _LONG_AP, "", "T1", "period", _SHORT_AP, 1, True),
    ("s payables by supplier", 1, 2, "", "", _SHORT_AP, "", "T1", "period", _LONG_AP, 1, True),
    ("s payables by supplier", 1, 3, "", "", "", "", "T1", "period", "accounts payable to suppliers-combined", 1, True),
    ("s payables by term", 1, 1, "", "", "", "", "short or first", "period", _SHORT_AP, 1, True),
    ("s payables by term", 2, 1, "", "", "", "", "long or first", "period", _LONG_AP, 1, True),
    ("s accrued short", 1, 1, "", "", "", "", "T1", "period", "accrued expenses", 1, True),
    ("s accrued long", 1, 1, "", "", "", "", "T1", "period", "long-term accrued expenses", 1, True),
    ("s deferred revenue long", 1, 1, "", "", "", "", "T1", "period", "long-term deferred revenue", 1, True),
    ("s disposals", 1, 1, "", "", "", "", "T1", "period", "21", 1, True),
    ("s administration", 1, 1, "", "", "", "", "T1", "period", "26", 1, True),
    ("s standard", 1, 1, "", "", "", "", "T1", "period", "", 1, True),
]

# Sums that anchors of special notes must satisfy, column by column: (branch, check, test, side, anchor, sign).
# Both sides are signed sums; an empty cell of side 'whole' ends the comparison, elsewhere it counts as 0.
NOTE_IDENTITIES = [
    ("m bcc", "assets = liabilities", "", "part", "T1", 1), ("m bcc", "assets = liabilities", "", "total", "T2", 1),
    ("m convertible", "blocks = total", "", "part", "blocks", 1), ("m convertible", "blocks = total", "", "whole", "total", 1),
    ("m convertible", "blocks = after - within", "", "part", "blocks", 1), ("m convertible", "blocks = after - within", "", "whole", "after", 1),
    ("m convertible", "blocks = after - within", "", "whole", "within", -1),
    ("m preference", "blocks = total", "", "part", "blocks", 1), ("m preference", "blocks = total", "", "whole", "total", 1),
    ("m preference", "blocks = after - within", "", "part", "blocks", 1), ("m preference", "blocks = after - within", "", "whole", "after", 1),
    ("m preference", "blocks = after - within", "", "whole", "within", -1),
    ("m straight bonds", "blocks = total", "", "part", "blocks", 1), ("m straight bonds", "blocks = total", "", "whole", "total", 1),
    ("m straight bonds", "blocks = after - within", "", "part", "blocks", 1), ("m straight bonds", "blocks = after - within", "", "whole", "after", 1),
    ("m straight bonds", "blocks = after - within", "", "whole", "within", -1),
    ("m bad debts", "blocks = last row", "unpriced", "part", "blocks", 1), ("m bad debts", "blocks = last row", "unpriced", "whole", "G", 1),
    ("m bad debts", "blocks = short + long", "priced", "part", "blocks", 1), ("m bad debts", "blocks = short + long", "priced", "whole", "short", 1),
    ("m bad debts", "blocks = short + long", "priced", "whole", "long", 1),
    ("m deferred tax", "blocks = net", "", "part", "blocks", 1), ("m deferred tax", "blocks = net", "", "total", "behind T2", 1),
    ("m deferred tax", "assets + liabilities = last row", "rows left", "part", "long-term assets", 1),
    ("m deferred tax", "assets + liabilities = last row", "rows left", "part", "long-term liabilities", 1),
    ("m deferred tax", "assets + liabilities = last row", "rows left", "whole", "G", 1),
    ("s taxes", "blocks = within + after", "split", "part", "blocks", 1), ("s taxes", "blocks = within + after", "split", "whole", "within", 1),
    ("s taxes", "blocks = within + after", "split", "whole", "after", 1),
    ("s acquisition", "consideration = net assets + goodwill", "", "part", "net acquired", 1),
    ("s acquisition", "consideration = net assets + goodwill", "", "part", "goodwill", 1),
    ("s acquisition", "consideration = net assets + goodwill", "", "total", "consideration", 1),
    ("s acquisition", "outflow = consideration + cash", "", "part", "consideration", 1), ("s acquisition", "outflow = consideration + cash", "", "part", "cash acquired", 1),
    ("s acquisition", "outflow = consideration + cash", "", "total", "cash outflow", 1),
]
# Notes whose blocks add up to their last row; long-term provisions compare with the total row and leave the last block out.
_SUMMED = [
    "m accrued short", "m accrued long", "m deferred revenue long", "m grand total", "m first sub-total", "m biological short", "m biological long",
    "m revenue", "m receivables by customer", "m borrowings long", "m provisions short", "m other",
]
for _branch in _SUMMED:
    NOTE_IDENTITIES += [(_branch, "blocks = last row", "", "part", "blocks", 1), (_branch, "blocks = last row", "", "total", "G", 1)]
NOTE_IDENTITIES += [
    ("m provisions long", "blocks = total", "", "part", "blocks", 1), ("m provisions long", "blocks = total", "", "total", "total", 1),
    ("m provisions long", "last block = total", "", "part", "last block", 1), ("m provisions long", "last block = total", "", "total", "total", 1),
]
