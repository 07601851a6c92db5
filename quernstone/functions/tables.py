"""Lists and tables that results depend on."""

#: Patterns that results depend on: years, what a question may name, and numbers.
YEAR = r"\b20(?:2[0-9]|19)\b"
SYMBOL = r"\b[A-Z]{2,8}\b"
PROPER_PHRASE = r"\b[A-Z][a-z]+(?:[ '-][A-Z][a-z]+)*\b"
PLAIN_PHRASE = r"\b[a-z][a-z]+(?:\s[a-z][a-z]+)*\b"
NUMBER = r"[+-]?\d+(?:\.\d+)?"
SCALED_NUMBER = r"(?i)^([+-]?\d+(?:\.\d+)?)\s*([bmk]|billion|million|thousand)?s?$"

#: Section headings of an annual report, as they are matched.
SECTION_ITEMS = (
    "Item 1", "Item 1A", "Item 1B", "Item 2", "Item 3", "Item 4", "Item 5",
    "Item 6", "Item 7", "Item 7A", "Item 8", "Item 9", "Item 9A", "Item 9B",
    "Item 10", "Item 11", "Item 12", "Item 13", "Item 14", "Item 15", "Item 16",
)

#: Company aliases (lower case) and their tickers.
COMPANY_ALIASES = {
    "apple": "AAPL",
    "apple inc": "AAPL",
    "apple inc.": "AAPL",
    "microsoft": "MSFT",
    "microsoft corporation": "MSFT",
    "amazon": "AMZN",
    "amazon.com": "AMZN",
    "amazon inc": "AMZN",
    "google": "GOOGL",
    "alphabet": "GOOGL",
    "alphabet inc": "GOOGL",
    "meta": "META",
    "meta platforms": "META",
    "facebook": "META",
    "tesla": "TSLA",
    "tesla inc": "TSLA",
    "nvidia": "NVDA",
    "nvidia corporation": "NVDA",
    "berkshire hathaway": "BRK.B",
    "berkshire": "BRK.B",
}

#: Names in questions and their tickers.
QUERY_ALIASES = {
    "apple": "AAPL", "apples": "AAPL",
    "microsoft": "MSFT",
    "amazon": "AMZN",
    "google": "GOOGL", "alphabet": "GOOGL",
    "meta": "META", "facebook": "META",
    "tesla": "TSLA", "nvidia": "NVDA",
    "berkshire": "BRK.B", "berkshire hathaway": "BRK.B",
    "jpmorgan": "JPM", "jpmorgan chase": "JPM",
    "boeing": "BA",
    "johnson & johnson": "JNJ", "j&j": "JNJ",
    "coca-cola": "KO", "coca cola": "KO",
    "pfizer": "PFE",
    "walmart": "WMT",
    "exxon": "XOM", "exxonmobil": "XOM",
}

#: Tickers that are always known.
TICKERS = ("AAPL", "MSFT", "AMZN", "GOOGL", "NVDA", "META", "TSLA", "BRK.B")

#: Letters that misread forms of BRK.B leave.
BRK_FORMS = ("BRKB", "BRB", "BRO", "BR", "BRK")

#: Generic names that are not companies (ingestion).
NOISY_COMPANIES = (
    "services", "products", "research and development",
    "selling, general and administrative", "businesssegment", "riskfactor",
    "financialmetric", "company", "macroevent", "other companies", "others",
    "unspecified competitors", "unspecified companies", "unspecified",
    "our competitors", "our peers", "competitors",
    "competitors in technology sector",
    "competitors developing ai technologies", "company x", "none", "n/a",
    "various competitors", "other bet companies", "other housing companies",
    "major automotive companies", "mature and prosperous companies",
    "start-ups and emerging companies", "data center", "graphics",
    "compute & networking", "building products group",
    "consumer products group", "industrial products group",
    "industrial products", "railroad",
)
NOISY_COMPANY_PREFIXES = (
    "companies that", "companies with", "other companies", "other freight",
    "other participants", "third-party ", "unspecified ", "unknown ",
    "platform-based ecosystem competitors", "manufacturers and suppliers",
    "national manufacturers", "smaller regional manufacturers",
    "large global manufacturers",
)

#: Names that are noise in facts.
NOISE_NAMES = (
    "other companies", "others", "unspecified competitors",
    "unspecified companies", "unspecified", "our competitors", "our peers",
    "competitors", "not specified in the text", "none", "n/a", "1)",
    "businesssegment", "riskfactor", "financialmetric", "company",
    "macroevent",
)
NOISE_PREFIXES = (
    "companies that", "companies with", "other companies", "providers of",
    "including ", "such as ", "our other ", "other participants",
    "third-party ", "unspecified ", "unknown ", "across ",
)

#: Words that are no entity candidates.
STOPWORDS = (
    "what", "how", "was", "were", "did", "does", "its", "the", "and",
    "for", "of", "in", "to", "a", "an", "is", "are", "from", "by",
    "with", "about", "that", "this", "their", "have", "has", "as", "at",
    "do", "it", "on", "which", "per", "fiscal", "year", "total", "figure",
    "report", "reports", "operation", "operations", "business", "result",
    "results", "statement", "statements", "note", "notes", "much", "many",
    "would", "should", "could", "between", "than", "then", "more", "most",
    "due", "into", "during", "over", "under", "each", "other", "used",
    "use", "using", "based", "both", "better", "also", "still",
)
#: Words taken out before the rest of a question becomes one candidate.
COMPACT_WORDS = ("the", "and", "of", "in", "for", "net", "gross", "total", "increased", "decreased")

#: Metric names that add synonyms to a question.
METRIC_SYNONYMS = {
    "revenue": "net sales total net sales sales revenues total revenues net revenue",
    "net income": "net earnings profit earnings",
    "operating income": "operating profit income from operations",
    "eps": "earnings per share diluted eps",
    "total assets": "assets",
}
#: Words that mark a question about metrics.
METRIC_KEYWORDS = (
    "revenue", "sales", "net income", "net earnings", "eps", "operating income",
    "gross margin", "total assets", "cash", "debt", "liabilities", "equity",
)

#: Sections that rarely hold relations, and the words that keep their chunks.
SKIPPABLE_SECTION = r"table of contents|exhibit\s+\d+|power of attorney|signatures?"
KEEP_WORDS = ("revenue", "segment", "risk", "competitor", "subsidiary", "market")

#: Verbs that ask for ingestion, and what takes that back.
INGEST_VERBS = ("añade", "añadir", "ingesta", "ingestar", "agrega", "agregar", "add ", "ingest")
INGEST_NEGATIONS = ("no quiero que añadas", "no añadas", "no agregues")

#: Relations: name, source label, target label.
RELATIONS = (
    ("OPERATES_IN", "Company", "BusinessSegment"),
    ("REPORTED_METRIC", "Company", "FinancialMetric"),
    ("IMPACTS_REVENUE", "MacroEvent", "FinancialMetric"),
    ("MITIGATES_RISK", "BusinessSegment", "RiskFactor"),
    ("COMPETES_WITH", "Company", "Company"),
)
#: Relations from a chunk, by the label they point at.
MENTIONS = {
    "Company": "MENTIONS_COMPANY",
    "FinancialMetric": "MENTIONS_METRIC",
    "RiskFactor": "MENTIONS_RISK",
    "BusinessSegment": "MENTIONS_SEGMENT",
    "MacroEvent": "MENTIONS_EVENT",
}
LABELS = tuple(MENTIONS)

#: Words that say nothing about which company a request means.
RESOLUTION_FILLERS = (
    "añade", "añadir", "ingesta", "ingestar", "agrega", "agregar", "add", "ingest", "de", "la", "el", "en", "para", "por", "con", "y",
    "a", "the", "to", "for", "of", "in", "on",
)
