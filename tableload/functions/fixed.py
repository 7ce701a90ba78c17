"""Word lists, patterns, thresholds and texts that loads must agree on."""

from __future__ import annotations

# --- Fixed values: cells read as null (exact, case-sensitive) ---
NULL_TOKENS = ("", "NULL", "null", "NA", "N/A", "na", "n/a", "None", "none")

# --- Fixed values: the cell grammar used for schema inference ---
BOOLEAN_PATTERN = r"(?i)^(true|false)\z"
INTEGER_PATTERN = r"^[+-]?[0-9]{1,19}\z"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE_PATTERN = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\z"
TIMESTAMP_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?\z"
)

# --- Fixed values: date shapes looked for inside text columns when profiling ---
DATE_LIKE_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{2}/\d{2}/\d{4}",
)

# --- Fixed values: column naming ---
RESERVED_NAMES = ("table", "column", "select", "where", "from", "order", "group", "by")
UNNAMED = "unnamed_column"
NAME_PREFIX = "col_"

# --- Fixed values: defaults ---
DRY_RUN_ROWS_PER_SECOND = 5000
MIN_SCORE = 75
TOP_COLUMNS = 5
MIN_COLUMN_MATCH = 0.7
MAX_TYPE_MISMATCH = 0.3
LATEST_JOBS = 50
KEEP_JOBS = 100
KEEP_DAYS = 30
TEST_JOB_PREFIX = "test_"

# --- Fixed values: inferred types an existing column type accepts (besides its own) ---
ACCEPTED_TYPES = {
    "INTEGER": ("BIGINT", "DOUBLE", "DECIMAL", "VARCHAR"),
    "BIGINT": ("DOUBLE", "DECIMAL", "VARCHAR", "INTEGER"),
    "REAL": ("DOUBLE", "VARCHAR"),
    "DOUBLE": ("VARCHAR",),
    "VARCHAR": ("CHAR", "INTEGER", "BIGINT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP"),
    "CHAR": ("VARCHAR", "INTEGER", "BIGINT"),
    "DATE": ("VARCHAR", "TIMESTAMP"),
    "TIMESTAMP": ("VARCHAR", "DATE"),
    "BOOLEAN": ("VARCHAR",),
}

# --- Fixed values: partition advice scores; per class the first true condition counts.
#     r = distinct/non-null ratio, u = distinct values, e = evenness, nulls = null rows ---
SCORES = {
    "datetime": (
        ("r >= 0.9D", 70),
        ("r >= 0.3D", 90),
        ("r >= 0.05D", 95),
        ("u >= 10", 85),
        ("u >= 3", 75),
        ("true", 60),
    ),
    "numeric": (
        ("r > 0.5D or r < 0.01D", 30),
        ("r > 0.3D", 75),
        ("r > 0.15D", 80),
        ("r >= 0.05D", 85),
        ("true", 60),
    ),
    "string": (
        ("r > 0.4D", 30),
        ("r > 0.2D", 70),
        ("r >= 0.05D and e >= 0.7D", 85),
        ("r >= 0.05D and e >= 0.5D", 80),
        ("r >= 0.05D", 50),
        ("r >= 0.02D and u >= 200", 30),
        ("r >= 0.02D and e >= 0.6D", 75),
        ("r >= 0.02D", 40),
        ("e >= 0.8D and u >= 5", 60),
        ("true", 20),
    ),
    "boolean": (("nulls > 0", 30), ("true", 20)),
}

# --- Fixed values: recommended transforms (name, width, description, example note) ---
TRANSFORMS = {
    "datetime": (
        ("r >= 0.9D", (("year", None, "Partition by year (high cardinality column)", ""),)),
        (
            "r >= 0.3D",
            (
                ("year", None, "Partition by year", ""),
                ("month", None, "Partition by month", ""),
            ),
        ),
        (
            "r >= 0.05D",
            (
                ("year", None, "Partition by year", ""),
                ("month", None, "Partition by month", ""),
                ("day", None, "Partition by day", ""),
            ),
        ),
        ("u >= 10", (("identity", None, "Partition directly by date (low cardinality)", ""),)),
        ("u >= 3", (("identity", None, "Partition directly by date (very low cardinality)", ""),)),
        (
            "true",
            (
                (
                    "identity",
                    None,
                    "Limited partitioning value (extremely low cardinality)",
                    " -- Warning: Very few unique values",
                ),
            ),
        ),
    ),
    "numeric": (
        ("r > 0.01D and u < 1000", (("bucket", 10, "Hash into 10 buckets", ""),)),
        ("r > 0.01D", (("bucket", 100, "Hash into 100 buckets", ""),)),
        ("true", (("identity", None, "Partition directly by this column", ""),)),
    ),
    "string": (
        ("r > 0.4D", (("bucket", 50, "Hash into 50 buckets", ""),)),
        (
            "r > 0.2D",
            (
                ("truncate", 5, "Truncate to first 5 characters", ""),
                ("bucket", 20, "Hash into 20 buckets", ""),
            ),
        ),
        (
            "r >= 0.05D and e >= 0.7D",
            (
                (
                    "identity",
                    None,
                    "Partition directly by this column (excellent distribution)",
                    "",
                ),
            ),
        ),
        (
            "r >= 0.05D and e >= 0.5D",
            (("identity", None, "Partition directly by this column (good distribution)", ""),),
        ),
        (
            "r >= 0.05D",
            (("bucket", 10, "Hash into 10 buckets to counter uneven distribution", ""),),
        ),
        ("r >= 0.02D and u >= 200", (("bucket", 50, "Hash into 50 buckets", ""),)),
        (
            "r >= 0.02D and e >= 0.6D",
            (("identity", None, "Partition directly by this column", ""),),
        ),
        (
            "r >= 0.02D",
            (
                (
                    "identity",
                    None,
                    "Not recommended due to uneven distribution",
                    " -- Warning: Uneven distribution",
                ),
            ),
        ),
        (
            "e >= 0.8D and u >= 5",
            (("identity", None, "Partition directly by this column", ""),),
        ),
        (
            "true",
            (
                (
                    "identity",
                    None,
                    "Not recommended: too few unique values",
                    " -- Warning: Too few unique values",
                ),
            ),
        ),
    ),
    "boolean": (
        ("nulls > 0", (("identity", None, "Partition by boolean value (only with nulls)", ""),)),
        ("true", ()),
    ),
}

# --- Fixed values: score bands ---
BANDS = ((90, "Perfect"), (80, "Excellent"))
LOWEST_BAND = "Very Good"

# --- Fixed values: job status labels ---
STATUS_LABELS = {
    "pending": "Pending",
    "running": "Running",
    "completed": "Completed",
    "failed": "Failed",
}
TERMINAL_STATUSES = ("completed", "failed")
