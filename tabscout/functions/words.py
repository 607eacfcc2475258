"""Word lists and limits of the rules.

Everything here is a fixed value: results are only right when these lists and
numbers are exactly the ones the rules were written for.
"""

# --- fixed values: words inside column names -------------------------------
ID_WORDS = (
    "account", "acct", "code", "email", "guid", "hash", "id", "ids", "index", "ip",
    "key", "passport", "phone", "postal", "record", "row", "sku", "slug", "ssn",
    "token", "uri", "url", "uuid", "zip", "zipcode",
)
BAD_AXIS_WORDS = ID_WORDS + (
    "address", "comment", "comments", "description", "first", "last", "name", "notes", "text",
)
DATE_WORDS = ("created", "date", "day", "month", "time", "timestamp", "updated", "year")
OUTCOME_WORDS = (
    "active", "approved", "bought", "canceled", "cancelled", "churn", "conversion",
    "converted", "default", "failed", "fraud", "label", "lost", "outcome", "paid", "passed",
    "purchased", "retained", "status", "success", "survived", "target", "won",
)
LATITUDE_WORDS = ("lat", "latitude")
LONGITUDE_WORDS = ("lng", "lon", "long", "longitude")
MEASURE_GUARD_WORDS = (
    "age", "amount", "cost", "fare", "height", "income", "price", "rating", "revenue",
    "salary", "sales", "score", "weight",
)
SUM_WORDS = (
    "amount", "clicks", "income", "loss", "orders", "payment", "profit", "qty", "quantity",
    "revenue", "sales", "spend", "units", "views", "volume",
)
MEAN_WORDS = ("age", "nps", "percent", "percentage", "rate", "rating", "ratio", "score")
MEDIAN_WORDS = ("cost", "fare", "price", "salary", "value", "wage")

# --- fixed values: what counts as the positive class, best first -----------
POSITIVE_VALUES = (
    "1", "true", "yes", "y", "survived", "converted", "success", "approved", "active",
    "retained", "paid", "won", "passed",
)

# --- fixed values: labels --------------------------------------------------
LABEL_FIXES = {
    "id": "ID",
    "lat": "Latitude",
    "lng": "Longitude",
    "lon": "Longitude",
    "nps": "NPS",
    "parch": "Parents/Children",
    "pclass": "Passenger Class",
    "roi": "ROI",
    "sibsp": "Siblings/Spouses",
    "sku": "SKU",
    "url": "URL",
}
UPPER_WORDS = ("api", "id", "ip", "nps", "roi", "sku", "url")

# --- fixed values: cells of a text file that mean "missing" ----------------
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: limits of the selection ---------------------------------
FAMILY_LIMITS = {
    "overview": 1, "quality": 1, "geo": 1, "outcome": 5, "segment": 4, "time": 3,
    "relationship": 2, "distribution": 2, "composition": 1,
}
OTHER_FAMILY_LIMIT = 2
MAX_VIEWS = 12
MIN_VIEWS_BY_ID = 4
FILL_VIEWS = 8
MAX_DIGEST_VIEWS = 45
MAX_COMPACT_COLUMNS = 90

# --- fixed values: longest accepted replacement text per field --------------
TEXT_LIMITS = {
    "question": 140, "title": 90, "x_label": 50, "y_label": 50, "why": 220, "takeaway": 240,
}
SUMMARY_LENGTH = (20, 700)

# --- fixed values: what a number looks like in text --------------------------
NUMBER_PATTERN = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)

# --- fixed values: text patterns that look like a date ----------------------
DATE_PATTERN = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"

# Which datetime pattern reads a text, decided by the look of the text; the
# first matching row wins.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}$", "yyyy-M-d H:m:s.SSSSSSSSS"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}$", "yyyy-M-d'T'H:m:s.SSSSSSSSS"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$", "yyyy-M-d'T'H:m:s'Z'"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}Z$", "yyyy-M-d'T'H:m:s.SSSSSSSSS'Z'"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}$", "yyyy/M/d H:m"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^(1[3-9]|2\d|3[01])-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "d/M/yyyy H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/yyyy H:m"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{2}:\d{2}$", "yyyy-M-d'T'H:m:sXXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}[+-]\d{2}:\d{2}$", "yyyy-M-d'T'H:m:s.SSSSSSSSSXXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}[+-]\d{2}:\d{2}$", "yyyy-M-d H:m:sXXX"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{1,2} [AP]M$", "d/M/yyyy h:m a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2} [AP]M$", "M/d/yyyy h:m a"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AP]M$", "d/M/yyyy h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AP]M$", "M/d/yyyy h:m:s a"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2} [AP]M$", "yyyy-M-d h:m:s a"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Z][a-z]{2}-\d{4}$", "MMM-yyyy"),
    (r"^[A-Z][a-z]{2} \d{4}$", "MMM yyyy"),
    (r"^[A-Z][a-z]{3,} \d{4}$", "MMMM yyyy"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^(1[0-9]|20)\d{2}(0[1-9]|1[0-2])([0-2]\d|3[01])$", "yyyyMMdd"),
    (r"^(1[0-9]|20)\d{2}$", "yyyy"),
)
