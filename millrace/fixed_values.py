"""Names, shapes, patterns and texts that outputs must carry unchanged.

Nothing here is logic.  Each table is written out plainly, in natural order, because a
dataset prepared with other values would not be the dataset the user asked for.
"""

# Output shapes.  "" marks a leaf to fill, a list of dicts a fixed-length list of messages.
TEMPLATES = {
    "instruction": {"prompt": "", "completion": ""},
    "chat": {"messages": [{"role": "user", "content": ""}, {"role": "assistant", "content": ""}]},
    "qa": {"question": "", "answer": ""},
    "openai_fine_tuning": {
        "messages": [
            {"role": "system", "content": ""},
            {"role": "user", "content": ""},
            {"role": "assistant", "content": ""},
        ]
    },
    "anthropic_format": {"input": "", "output": ""},
    "alpaca": {"instruction": "", "input": "", "output": ""},
    "llama": {"text": ""},
    "mistral": {"instruction": "", "response": ""},
    "custom": {},
}

# Rule type names and the labels a Type Check may name.
RULE_TYPES = (
    "Required",
    "Type Check",
    "Regex Match",
    "Min Length",
    "Max Length",
    "Min Value",
    "Max Value",
    "Custom Python",
)
TYPE_CHECK_LABELS = ("string", "number", "boolean", "list", "dict")
ALL_FIELDS = "ALL_FIELDS"

# Column-name patterns for sensitive fields, tried in this order on the lower-case name.
SENSITIVE_NAME_PATTERNS = {
    "email": r"email|mail|e-mail",
    "name": r"name|username|user|author",
    "phone": r"phone|tel|mobile",
    "address": r"address|location|city|state|zip|postal",
    "id": r"id$|identifier|account",
    "ip": r"ip$|ip_address",
    "ssn": r"ssn|social|security",
    "credit_card": r"credit|card|payment",
    "dob": r"birth|dob|birthday",
}

# Texts of the two whole-dataset checks.
MESSAGE_EMPTY = "Dataset is empty. Nothing to validate."
MESSAGE_DUPLICATE = "Duplicate record found."
MESSAGE_FIELD_SET = "Inconsistent set of fields compared to the first row."

# Marker written into empty template leaves, and the constant for unknown pseudonym types.
AUTO_FILLED = "<AUTO_FILLED_{}>"
ANONYMIZED = "ANONYMIZED_{}"

# Keywords of the error scan, in matching order.
ERROR_KEYWORDS = (
    "error", "exception", "fail", "failed", "fatal", "critical", "traceback",
    "unhandled", "denied", "timeout", "refused", "not found", "cannot open", "unable to",
    "syntax error", "type error", "name error", "attribute error", "import error",
    "indentation error", "unicode error", "value error", "key error", "index error",
    "runtime error", "memory error", "overflow error", "zero division", "assertion error",
    "file not found", "permission denied", "access denied", "connection refused",
    "broken pipe", "operation timed out", "host unreachable", "network unreachable",
)

# Keywords of the release scan.
FORBIDDEN_KEYWORDS = (
    "TODO:", "FIXME:", "TEMP:", "DEBUG:", "HACK:",
    "REMOVEBEFORECOMMIT", "DONOTDISTRIBUTE", "PASSWORD", "SECRET_KEY",
)
MAX_SIZE_KB = 1024
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

# Texts that the public pandas CSV reader takes as missing by default.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# File extension -> format.
EXTENSIONS = {
    "json": "json",
    "jsonl": "jsonl",
    "csv": "csv",
    "tsv": "tsv",
    "txt": "txt",
    "parquet": "parquet",
    "xml": "xml",
    "yaml": "yaml",
    "yml": "yaml",
    "avro": "avro",
    "sqlite": "sqlite",
    "db": "sqlite",
}

# Root elements that hold records and are never one themselves.
XML_WRAPPERS = ("dataset", "records", "root")
