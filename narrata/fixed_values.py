"""Fixed values that must equal the original project's for equal results.

Everything here is data, stated plainly and in its natural order: the raw
product label map, the issue-to-group map, the priority lexicons, the
rule-based issue keywords, the two stop-word lists and the default
parameters. Operators take these as parameter defaults; callers may pass
their own.
"""

# --------------------------------------------------------------------------
# FIXED VALUES — do not edit; they define result parity.
# --------------------------------------------------------------------------

RANDOM_SEED = 42
MIN_WORD_COUNT = 20
DATE_CUTOFF = "2023-08-01"
MAX_PER_CLASS = 15000
MIN_PER_CLASS = 1000
GATE_MIN_WORDS = 10
MAX_LEN = 256
MAX_VOCAB = 50000
MIN_FREQ = 3
PAD_IDX = 0
UNK_IDX = 1
REDACTED = "[redacted]"

# raw product label -> normalised product (20 -> 9)
PRODUCT_LABEL_MAP = {
    "Credit reporting, credit repair services, or personal consumer reports": "Credit reporting",
    "Credit reporting": "Credit reporting",
    "Credit reporting or other personal consumer reports": "Credit reporting",
    "Debt or credit management": "Personal/payday loan",
    "Debt collection": "Debt collection",
    "Credit card or prepaid card": "Credit card",
    "Credit card": "Credit card",
    "Prepaid card": "Credit card",
    "Checking or savings account": "Checking/savings account",
    "Mortgage": "Mortgage",
    "Student loan": "Student loan",
    "Vehicle loan or lease": "Vehicle loan/lease",
    "Money transfer, virtual currency, or money service": "Money transfer",
    "Money transfers": "Money transfer",
    "Virtual currency": "Money transfer",
    "Payday loan, title loan, or personal loan": "Personal/payday loan",
    "Payday loan, title loan, personal loan, or advance": "Personal/payday loan",
    "Payday loan": "Personal/payday loan",
    "Personal loan": "Personal/payday loan",
    "Title loan": "Personal/payday loan",
}

# raw issue -> issue group (71 -> 7; anything else is OTHER_GROUP)
ISSUE_GROUP_MAP = {
    "Billing disputes": "Billing/Payment",
    "Billing statement": "Billing/Payment",
    "Problem with a purchase shown on your statement": "Billing/Payment",
    "Fees or interest": "Billing/Payment",
    "Other fee": "Billing/Payment",
    "Charged fees or interest while I was paying on time": "Billing/Payment",
    "Problem with fees": "Billing/Payment",
    "Was charged for something I did not purchase with the card": "Billing/Payment",
    "Late fee": "Billing/Payment",
    "Balance transfer fee": "Billing/Payment",
    "Problem when making payments": "Billing/Payment",
    "Struggling to pay your bill": "Billing/Payment",
    "Unexpected or other fees": "Billing/Payment",
    "Problem with a lender or other company charging your account": "Billing/Payment",
    "Fraud or scam": "Fraud/Security",
    "Identity theft / Fraud / Embezzlement": "Fraud/Security",
    "Problem with fraud alerts or security freezes": "Fraud/Security",
    "Unauthorized transactions/trans am not responsible for": "Fraud/Security",
    "Took or threatened to take negative or legal action": "Fraud/Security",
    "False statements or representation": "Fraud/Security",
    "Managing an account": "Account Access",
    "Opening an account": "Account Access",
    "Closing an account": "Account Access",
    "Closing your account": "Account Access",
    "Problem with a company's investigation into an existing problem": "Account Access",
    "Problem with a company's investigation into an existing issue": "Account Access",
    "Deposits and withdrawals": "Account Access",
    "Problem adding money": "Account Access",
    "Getting a credit card": "Account Access",
    "Problem getting a card or closing an account": "Account Access",
    "Closing on a mortgage": "Account Access",
    "Customer service / Customer relations": "Customer Service",
    "Getting a line of credit": "Customer Service",
    "Problem with customer service": "Customer Service",
    "Communication tactics": "Customer Service",
    "Written notification about debt": "Customer Service",
    "Advertising": "Customer Service",
    "Advertising and marketing, including promotional offers": "Customer Service",
    "Incorrect information on your report": "Reporting/Collections",
    "Credit monitoring or identity theft protection services": "Reporting/Collections",
    "Problem with a credit reporting company's investigation into an existing problem": "Reporting/Collections",
    "Improper use of your report": "Reporting/Collections",
    "Unable to get your credit report or credit score": "Reporting/Collections",
    "Credit report and/or credit score": "Reporting/Collections",
    "Attempts to collect debt not owed": "Reporting/Collections",
    "Cont'd attempts collect debt not owed": "Reporting/Collections",
    "Threatened to contact someone or share information improperly": "Reporting/Collections",
    "Dealing with your lender or servicer": "Loan Servicing",
    "Struggling to pay mortgage": "Loan Servicing",
    "Trouble during payment process": "Loan Servicing",
    "Struggling to repay your loan": "Loan Servicing",
    "Problem with the payoff process at the end of the loan": "Loan Servicing",
    "Applying for a mortgage or refinancing an existing mortgage": "Loan Servicing",
    "Applying for a mortgage": "Loan Servicing",
    "Loan modification,collection,foreclosure": "Loan Servicing",
    "Loan servicing, payments, escrow account": "Loan Servicing",
    "Getting a loan or lease": "Loan Servicing",
    "Getting a loan": "Loan Servicing",
    "Managing the loan or lease": "Loan Servicing",
    "Problems at the end of the loan or lease": "Loan Servicing",
    "Repossession": "Loan Servicing",
    "Vehicle was repossessed or sold the vehicle": "Loan Servicing",
    "Problem with a purchase or transfer": "Technical/App",
    "Money was not available when promised": "Technical/App",
    "Other transaction problem": "Technical/App",
    "Confusing or missing disclosures": "Technical/App",
    "Problem caused by your funds being low": "Technical/App",
    "Other features, terms, or problems": "Technical/App",
    "Overdraft, currentBalance, or other account problems": "Technical/App",
    "Problem with overdraft": "Technical/App",
    "Electronic communications": "Technical/App",
}
OTHER_GROUP = "Other"

# priority lexicons: substring hits, distinct keywords counted
PRIORITY_KEYWORDS = {
    "high": [
        "fraud", "scam", "identity theft", "unauthorized transaction",
        "cannot access money", "foreclosure", "stolen", "identity stolen",
        "unauthorized charge", "garnish", "wage garnishment", "sue",
        "lawsuit", "legal action", "repossession", "harassment",
        "threaten", "fdcpa", "fcra violation",
    ],
    "medium": [
        "billing dispute", "delayed refund", "overcharged", "late fee",
        "incorrect balance", "wrong amount", "error on report",
        "inaccurate information", "dispute", "penalty", "denied",
        "closed account", "cannot open account",
    ],
    "low": [
        "dissatisfaction", "general complaint", "question", "inquiry",
        "information request", "status update", "slow response",
    ],
}
PRIORITY_ORDER = ["Critical", "High", "Medium", "Low"]

# rule-based issue group from text: first matching rule wins
ISSUE_RULES = [
    ("Fraud/Security", ["fraud", "scam", "stolen", "unauthorized", "identity theft"]),
    ("Billing/Payment", ["billing", "payment", "charge", "fee", "refund"]),
    ("Account Access", ["cannot login", "locked", "access", "password"]),
    ("Reporting/Collections", ["report", "credit report", "collection", "debt"]),
    ("Loan Servicing", ["loan", "mortgage", "foreclosure", "servicer"]),
]
ISSUE_RULE_DEFAULT = "Customer Service"
ISSUE_RULE_CONFIDENCE = 0.6

# error types, in test order
ERROR_SHORT_WORDS = 30
ERROR_LONG_WORDS = 200
ERROR_LOW_CONFIDENCE = 0.5

# stop words of the exploratory word counts (notebook list)
EDA_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't",
    "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't",
    "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren",
    "weren't", "won", "won't", "wouldn", "wouldn't", "redacted", "xxxx", "xx",
    "said", "told", "called", "would", "also", "get", "got", "one", "two", "three",
    "could", "make", "made", "like", "know", "still", "even", "back", "never",
    "however", "well", "since", "yet", "without", "upon", "within", "us", "per",
]

# stop words of the chart word counts (chart script list)
CHART_STOPWORDS = [
    "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her",
    "it", "its", "they", "them", "their", "what", "which", "who", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "have", "has",
    "had", "do", "does", "did", "a", "an", "the", "and", "but", "if", "or", "as",
    "of", "at", "by", "for", "with", "to", "from", "in", "on", "not", "also", "get",
    "got", "one", "two", "three", "said", "told", "called", "would", "could", "make",
    "made", "like", "know", "still", "even", "back", "never", "well", "since", "yet",
    "redacted", "xxxx", "xx", "complaint", "company", "account", "bank", "financial",
    "consumer", "per", "us", "however", "upon", "within", "without",
]

# profile parameters
LENGTH_CLIP = 500
LENGTH_BINS = 60
CUTOFFS = [64, 128, 192, 256, 512]
PERCENTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
EXCERPT_WORDS = 60
SUMMARY_FALLBACK_CHARS = 300
F1_BANDS = (0.85, 0.70)
