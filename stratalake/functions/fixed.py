"""Results depend on these words, weights and patterns being as they are."""

NULL_WORDS = ("", "na", "n/a", "null", "none", "-", "--", "nil", "nan", "undefined")
TRUE_WORDS = ("true", "yes", "y", "t", "1")
FALSE_WORDS = ("false", "no", "n", "f", "0")
CURRENCY_SIGNS = "$€£₹¥₩"
DELIMITERS = (",", "\t", ";", "|")

GEOGRAPHIC_WORDS = (
    "country", "region", "state", "province", "city", "territory", "zone", "area", "continent", "district", "county",
    "postcode", "zip", "postal", "latitude", "longitude", "address", "location", "market", "branch", "office",
)
MEASURE_WORDS = (
    "revenue", "sales", "amount", "total", "sum", "profit", "cost", "price", "value", "quantity", "qty", "count",
    "volume", "units", "orders", "transactions", "income", "expense", "spend", "budget", "forecast", "target",
    "salary", "wage", "rate", "fee", "discount", "margin", "commission", "ebitda", "gpv", "gmv", "arpu", "ltv", "cac",
)
IDENTIFIER_STARTS = ("id", "uuid", "guid", "sku", "isbn", "asin", "serial")
IDENTIFIER_TOKENS = ("id", "uuid", "guid", "code", "key", "sku", "isbn", "asin", "serial", "hash", "token", "identifier")

STOP_WORDS = tuple(
    "a an the and or but if then else when at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further once here there all any both each few more "
    "most other some such no nor not only own same so than too very can will just should now is are was were be been "
    "being have has had having do does did doing of as i me my we our you your he she it they them this that these "
    "those what which who whom whose how why".split()
)
QUESTION_STOP_WORDS = (
    *STOP_WORDS,
    *"show tell give get make use using used value values data column row rows please need want see look find list say".split(),
)
POSITIVE_WORDS = tuple(
    "good great excellent positive strong growth increase gain success improve benefit opportunity advantage best "
    "better outstanding robust reliable effective efficient innovative leading".split()
)
NEGATIVE_WORDS = tuple(
    "bad poor negative weak decline decrease loss fail failure risk threat problem issue concern down drop fall worse "
    "worst unreliable ineffective deficient outdated lagging".split()
)
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Edges of words are those of ASCII letters, digits and underscore.
ENTITY_PATTERNS = {
    "email": r"(?i)(?<![A-Za-z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Za-z0-9_])",
    "url": r"(?i)(?<![A-Za-z0-9_])https?://[^\s<]+",
    "phone": r"(?:\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3,4}[\s.-]?\d{4}",
    "date": r"(?<![A-Za-z0-9_])(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s*\d{4})(?![A-Za-z0-9_])",
    "currency": r"(?i)(?:[$€£₹¥₩]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|M|billion|B|k|thousand))?)|(\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|INR|JPY|CNY))",
    "percentage": r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?\s?%",
    "id": r"(?<![A-Za-z0-9_])[A-Z]{2,}-\d{3,}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])\d{6,}(?![A-Za-z0-9_])",
}
READING_LABELS = (
    (90, "very easy (5th grade)"),
    (70, "easy (7th grade)"),
    (60, "standard (8-9th grade)"),
    (50, "fairly difficult (10-12th grade)"),
    (30, "difficult (college)"),
    (0, "very difficult (college graduate)"),
)
QUALITY_WEIGHTS = {"Completeness": 0.35, "Uniqueness": 0.25, "Consistency": 0.20, "Type Richness": 0.10, "Volume": 0.10}
FAMILY_BOOST = {"column_stats": 0.10, "insights": 0.08, "correlations": 0.06, "summary": 0.04, "row_group": 0.02}
QUESTION_VARIANTS = (
    (r"\b(top|highest|best|max|largest|biggest)\b", "maximum"),
    (r"\b(bottom|lowest|worst|min|smallest)\b", "minimum"),
    (r"\bhow many\b", "count of"),
    (r"\baverage\b", "mean"),
)
