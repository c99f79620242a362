"""Patterns, words and tolerances that the results depend on."""

TOTAL_ROW = (
    r"(?i)^\s*(total\b|net\b|gross (profit|margin)|operating (profit|income|expenses)\b"
    r"|(net\s+)?profit (for the|before|attributable)|loss (for the|before)"
    r"|profit/\(loss\)|earnings before|ebitda|comprehensive income for the year"
    r"|cash (generated|used|and cash equivalents)|net cash)"
)
HARD_TOTAL = (
    r"(?i)^\s*(total\b|gross (profit|margin)|(net\s+)?(profit|loss) (for the|before)"
    r"|profit/\(loss\) before|operating profit\b|earnings before|ebitda"
    r"|comprehensive income for the year|net cash (generated|used|flows?))"
)
PROSE = r"(?i)[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}"
PROFIT_ROW = r"(?i)^\s*(net\s+)?(profit|loss) for the (year|period)\b(\s+(profit\s+)?attributable\s+to\s*:?|\s+other comprehensive.*|\s+from continuing operations)?\s*$"
PROFIT_ROW_SERIES = r"(?i)^\s*(net\s+)?(profit|loss) for the (year|period)\b(\s+(profit\s+)?attributable\s+to\s*:?)?\s*$"
OCI_ROW = r"(?i)other comprehensive (income|loss|\()|total comprehensive income|earnings per share|^\s*basic\b.*diluted"
BALANCE_ROW = r"(?i)(as )?(at|balance).{0,4}(1 january|31 december|beginning|end)"
EQUITY = r"(?i)(shareholders['’]?|owners['’]?)\s+equity\b(?!\s+and)|\btotal equity\b(?!\s+and)|shareholders['’]?\s+funds\b"
CASH_OPERATING = r"(?i)(net cash|cash).{0,4}(generated (from|by)|used (in|for)|(in|from|flows? from))\s+operating|generated from operating activities"
CASH_INVESTING = r"(?i)(net )?cash (used (in|for)|generated (from|by)|(in|from))\s+investing|used in investing activities"
CASH_FINANCING = r"(?i)(net\s+)?cash\s+.{0,30}financing activities\s*$"
CASH_CHANGE = r"(?i)(net\s+)?\(?(increase|decrease|decline)\)?[\s/()a-z]{0,20}in cash( and cash equivalents)?"
CASH_BLOCK = r"(?i)^\s*(cash flows? (from|used (in|for))\s+)?financing activities\s*$"
CASH_OPENING = r"(?i)(cash and (cash equivalents|bank balances)|equivalents) at (the )?(beginning|start|1 jan)"
CASH_CLOSING = r"(?i)(cash and (cash equivalents|bank balances)|equivalents) at (the )?(end|31 dec|close)"
CASH_FX = r"(?i)effect of (foreign )?(exchange|currency)|exchange rate changes|currency (translation|retranslation)"
HEADER_UNITS = r"(?i)AED|USD|EGP|SAR|['’]000|\bnotes?\b"
HIGHLIGHTS = r"(?i)\bebitda\b|\bhighlights?\b|profit and loss summary|balance sheet summary|cash flow summary"
MARGIN_ROW = r"(?i)^[\w /()-]{0,24}\bmargin\b\s*%?$"
KNOWN_LINE = (
    r"(?i)^(revenue|turnover|cost of sales|gross profit|operating (profit|expenses|income)"
    r"|finance (income|costs?|expense)|profit (before|for the|attributable)"
    r"|(loss|profit)/?\(?(loss|profit)?\)?|income tax|taxation|depreciation|amortisation"
    r"|impairment|share of (results|profit|loss)|dividends?|federal royalty|royalty"
    r"|total\b|net\b|non-current|current|inventories|trade (and other )?(receivables|payables)"
    r"|cash (and )?(cash equivalents|bank balances|generated|used)|borrowings|lease"
    r"|property, plant|intangible|goodwill|provisions?|retained earnings|share (capital|premium)"
    r"|other (comprehensive|reserves|income|assets|liabilities)|changes in|adjustments for"
    r"|purchase of|proceeds from|acquisition of|repayment of|payment of|interest (paid|received)"
    r"|(basic|diluted).*(earnings|per share)|earnings per share|cash flows? (from|used)"
    r"|equity( and liabilities)?|liabilities|assets|represented by|attributable to)"
)
ANCHORS = [
    "revenue", "turnover", "total income", "operating income", "cost of sales", "operating expenses", "operating profit", "profit before", "profit for the year", "net profit",
    "total assets", "total equity", "total liabilities", "net assets", "non-current assets", "current assets", "share capital", "cash flows from operating", "net cash",
    "cash and cash equivalents", "financing activities", "investing activities", "balance at", "as at 1 january", "total comprehensive income", "net income", "cost of revenue",
    "gross profit", "gross margin", "income before income taxes", "income before taxes", "provision for income taxes", "stockholders' equity", "stockholders equity",
    "total current assets", "total current liabilities",
]
LABEL_ALIASES = {
    "turnover": "revenue",
    "total revenue": "revenue",
    "revenues": "revenue",
    "cost of revenue": "cost of sales",
    "profit before taxation": "profit before tax",
    "profit before income tax": "profit before tax",
    "income tax expense": "income tax",
    "income tax expenses": "income tax",
    "taxation": "income tax",
    "net profit for the year": "profit for the year",
    "profit for the period": "profit for the year",
    "depreciation and amortisation": "depreciation and amortization",
    "property plant and equipment": "property plant equipment",
    "trade and other receivables": "trade receivables",
    "trade and other payables": "trade payables",
    "cash and bank balances": "cash and cash equivalents",
    "cash and short term deposits": "cash and cash equivalents",
    "total shareholders equity": "total equity",
    "shareholders equity": "total equity",
    "shareholders funds": "total equity",
    "net cash from operating activities": "net cash generated from operating activities",
    "net cash used in operating activities": "net cash generated from operating activities",
    "net cash flows from operating activities": "net cash generated from operating activities",
}
STATEMENTS = ["income statement", "statement of financial position", "statement of cash flows", "statement of changes in equity"]
FIRST_YEAR, LAST_YEAR = 1990, 2035
BARE_CURRENCY = r"^([$£€¥]\(?|\()$"
YEAR_TOKEN, YEAR_CONNECTOR = r"^\s*(19|20)\d{2}\s*$", r"(?i)^\s*[a-z]{2,10}\s*$"
GLUED_SECTION = (
    r"(?i)^(total\b[a-z\s/-]*?(?:assets|liabilities|equity)|net (?:current )?assets)\s+"
    r"((?:current|non[- ]?current|equity|liabilities|assets|represented)\b.*)$"
)
AUDITOR_PROSE = (
    r"(?i)we have audited|in our opinion|the consolidated financial statements|"
    r"material misstatement|reasonable assurance|internal control|"
    r"responsibilit|going concern|board of directors|signed on|"
    r"pricewaterhousecoopers|\bkpmg\b|\bdeloitte\b|ernst\s*&\s*young|\bey\b|"
    r"registered auditor|audit (evidence|opinion|procedures)|"
    r"united arab emirates federal law|articles of association|"
    r"whose report dated|expressed an unqualified"
)
LINE_AT_END = (
    r"(?i)(?:^|\s)((?:total|net)\b[\w\s'’/()-]{2,45}"
    r"(?:assets|liabilities|equity|current assets|current liabilities|profit|income|expenses))\s*$"
)
PHRASE_AT_END = r"([A-Z][A-Za-z][\w\s'’/&()-]{2,40})\s*$"
LINE_AT_START = r"^((?:total|net|gross|share|retained|current|non-current)[\w\s'’/()-]{2,45}?)(?:\s+[A-Z][a-z]+.*|$)"
LINE_IN_MIDDLE = (
    r"(?i)\b((?:total )?(?:non-current|current) (?:assets|liabilities)"
    r"|trade (?:and other )?(?:receivables|payables)"
    r"|due (?:from|to) (?:a )?related part(?:y|ies)"
    r"|property,? plant and equipment|cash and (?:cash equivalents|bank balances)"
    r"|share (?:capital|premium)|retained earnings|other reserves"
    r"|(?:total )?(?:non-current )?(?:current )?"
    r"(?:borrowings|provisions|inventories|deferred (?:tax|fees|revenue))"
    r"|employee benefits|net current assets)\b"
)
THREE_LONG_WORDS = r"[a-z]{4,}\s+[a-z]{4,}\s+[a-z]{4,}"
TRAILING_NOTE = r"\s+\d{1,2}(\.\d+)?(\s*,\s*\d{1,2}(\.\d+)?)*\s*(\([a-z0-9]{1,3}\)|\)[a-z0-9]{1,3}\()?\s*$"
LEADING_NOTE = r"^\s*\d{1,2}\s+(?=[\d()\-–])"
NOTE_MARK = r"(?i)^[)(]?[a-z0-9]{1,3}[)(]?$"
UNIT_CELL = r"(?i)^(\(?(19|20)\d\d\)?|(AED|USD|EGP|SAR)\s*['’]?\s*000|(31\s+december|december\s+31)(\s+\d{4})?|notes?)$"
NUMBER_TOKEN = r"\)-?[\d,]+(?:\.\d+)?\(%?|\(?-?[\d,]+(?:\.\d+)?\)?%?|[-–—�]"
REVERSED_WRAP = r"^\)\s*([\d,]+(?:\.\d+)?)\s*\n\s*([\d,]+(?:\.\d+)?)\s*\(\s*$"
STATEMENT_STARTS = [
    r"total assets\b|total liabilities\b|net assets\b",
    r"balance at \d|transactions with (the )?owners|total comprehensive income for the year",
    r"cost of sales\b|gross profit\b",
    r"cash flows? from operating activities|cash and cash equivalents at (the )?end",
]
