"""Word lists, patterns and thresholds that results depend on."""

# ---- name patterns, matched on the lower-cased name unless said otherwise ----
# matched on the name as written
KEY_NAME = r"(^|_)(id|ID|pk|PK)$|[a-z0-9](Id|ID)$|[kK](ey|EY)$"
MODEL_KEY_SUFFIX = r"(key|id)$"
DATE_NAME = r"date|time|created|modified|updated|timestamp|_dt$|_ts$|_at$"
NUMBER_NAME = r"(^|_)id$|num|code|amount|price|qty"
NUMBER_NAME_EXCEPT = r"guid|uuid"
NUMBER_PREFIX = (
    r"^(id|amount|price|cost|qty|quantity|total|sum|count|num|number|revenue|profit"
    r"|margin|budget|forecast|actual|target)"
)
SENSITIVE_NAME = r"credit|ssn|password|secret|phone|email|iban|swift|bic|license|tax.*id"
BOOLEAN_NAME = r"^is_|^has_|flag|active|enabled"
FREE_TEXT_NAME = (
    r"desc|comment|note|remark|text|memo|detail|summary|body|content|reason|explanation"
)
HIDE_TEXT_NAME = r"description|comment|remark|note"
GUID_NAME = r"guid|uuid|objectid"
HIDE_GUID_NAME = r"guid|uuid|^correlation_id$|^request_id$"
TIMESTAMP_NAME = r"timestamp|datetime|_ts$|_at$"
BAD_IDENTIFIER = r"[^A-Za-z0-9_]"
DATE_TABLE_NAME = r"date|calendar|kalender|zeit"
REPEATED_NAME_EXCEPT = (
    r"^(id|key|date|name|type|status|code|description|created|modified|updated)"
)

CREATED_NAMES = ("created_at", "created_date", "createdat", "createddate", "__created_at")
UPDATED_NAMES = (
    "updated_at", "updated_date", "modified_at", "modified_date",
    "updatedat", "modifiedat", "updateddate", "modifieddate", "__updated_at",
)
LAYER_WORDS = (
    ("bronze", ("bronze", "raw", "landing", "ingest", "stage")),
    ("silver", ("silver", "refined", "intermediate", "cleansed", "enriched")),
    ("gold", ("gold", "curated", "consumption", "serving", "analytics")),
)
BOOLEAN_WORDS = ("yes", "no", "true", "false", "y", "n", "ja", "nein", "0", "1", "on", "off")
DEPRECATED_TYPES = ("text", "ntext", "image")
SYSTEM_SCHEMAS = ("sys", "INFORMATION_SCHEMA", "queryinsights")

# ---- format strings by keyword class, first match wins ----
FORMAT_CLASSES = (
    (r"pct|percent|ratio|rate", "0.0%"),
    (r"price|cost|revenue|amount|sales|profit", "$#,##0.00"),
    (r"avg|average|mean", "#,##0.00"),
)
FORMAT_DEFAULT = "#,0"

# ---- expression patterns, matched on the lower-cased text: (rule, pattern, negated pattern) ----
EXPRESSION_PATTERNS = (
    ("SM-001", r"iferror\s*\(", None),
    ("SM-002", r"\]\s*/(?!/)(?!\*)|\)\s*/(?!/)(?!\*)", None),
    ("SM-003", r"evaluateandlog\s*\(", None),
    ("SM-004", r"intersect\s*\(", None),
    ("SM-006", r"calculate\s*\([^,]+,\s*filter\s*\(\s*'?[a-z0-9 _]+'?\s*,", None),
    ("SM-007", r"^ *0 *\+|\+ *0 *$|divide\s*\(\s*[^,]+,\s*[^,]+,\s*0\s*\)", None),
    ("SM-011", r"\d+\s*[-+]\s*divide\s*\(|\d+\s*[-+]\s*sum\s*\([^)]+\)\s*/", None),
    ("SM-014", r"sumx\s*\(\s*'?[a-z0-9_ ]+'?\s*,\s*'?[a-z0-9_ ]+'?\s*\[[^\]]+\]\s*\)", None),
    ("SM-016", r"filter\s*\(\s*all\s*\(", None),
    ("SM-024", r"(^|[^a-z0-9_])all\s*\(", r"(^|[^a-z0-9_])allselected\s*\("),
    ("WH-007", r"select \*", None),
    ("WH-043", r"nolock|forceseek|forcescan", None),
)
# (rule, pattern, fires above this many occurrences)
OCCURRENCE_PATTERNS = (
    ("SM-013", r"calculate\s*\(", 1),
    ("SM-025", r"userelationship\s*\(", 3),
)
# text rewrites: (fix, pattern, replacement)
EXPRESSION_REWRITES = (
    ("SM-FIX-ADDZERO", r"^\s*0\s*\+\s*(?=\S)|(?<=\S)\s*\+\s*0\s*$", ""),
    ("SM-FIX-SUMX",
     r"(?i)SUMX\s*\(\s*'?([^',\)]+)'?\s*,\s*'?\1'?\s*\[([^\]]+)\]\s*\)", "SUM('$1'[$2])"),
    ("SM-FIX-REMOVEFILTERS", r"(?i)\bALL\s*\(", "REMOVEFILTERS("),
)

# failure message classes, first match wins
FAILURE_CLASSES = (
    ("timeout", r"timeout|timed out"),
    ("permission", r"permission|denied|unauthorized"),
    ("syntax", r"syntax|parse"),
    ("deadlock", r"deadlock"),
)

# personal-data classes looked for in values
PII_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}"),
    ("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    ("secret", r"(password|secret|token|api_key) ?[=:]"),
)
# a literal that every match of a class holds: a cheap test before the pattern
PII_LITERALS = {"email": "@"}
UUID_VALUE = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# ---- ranks and limits ----
STATUS_ORDER = ("FAIL", "ERROR", "WARN", "PASS", "N/A")
SEVERITY_ORDER = ("HIGH", "MEDIUM", "LOW", "INFO")
MB = 1024 * 1024
GB = 1024 * MB
SMALL_FILE = 25 * MB
LARGE_FILE = 1 * GB
LARGE_TABLE = 10 * GB

# ---- columns a query text refers to: inside aggregate calls, and in lists behind "by" ----
AGGREGATE_CALL = r"(?i)\b(?:avg|sum|count|dcount|stdev|min|max|percentile)\s*\(\s*(\w+)\s*\)"
BY_LIST = r"(?i)\bby\s+([^|\n]+)"
