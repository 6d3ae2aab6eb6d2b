"""Fixed values shared by the operators."""

# Score targets, in report order.
TARGETS = ("updrs_1", "updrs_2", "updrs_3", "updrs_4")
SCORED_TARGETS = ("updrs_1", "updrs_2", "updrs_3")

# Highest "mild" and highest "moderate" score per target.
SEVERITY_CUTS = {
    "updrs_1": (10, 21),
    "updrs_2": (12, 29),
    "updrs_3": (32, 58),
    "updrs_4": (4, 12),
}

# Probability at which a visit is called moderate-to-severe.
SCORE_THRESHOLDS = {"updrs_1": 0.46, "updrs_2": 0.22, "updrs_3": 0.28}

# Severity words and the binary code of each.
SEVERITY_CODES = {"mild": 0, "moderate": 1, "severe": 1}

# Medication states a visit may carry; NULL reads as "Unknown".
MEDICATION_STATES = ("Off", "On", "Unknown")

# Forecast horizons and delta horizons in months.
FORECAST_MONTHS = (0, 6, 12, 24)
DELTA_MONTHS = (12, 18, 24)
FIRST_YEAR = 12

N_FOLDS = 5

# Rows of one key that a single join task should take. A key with more rows is
# split, so a list of such keys has at most total_rows / HOT_ROWS entries.
HOT_ROWS = 2_000_000

# Buckets used to spread one ordered group over many tasks (see operators.ranking).
RANK_BUCKETS = 4096
