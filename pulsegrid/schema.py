"""Fixed values of the data model: column names, window sizes, tolerances."""

from __future__ import annotations

from pyspark.sql import types as T

# Identity of a recording: the patient folder and the file stem.
KEYS = ["grp", "record"]
TIME = "time_elapsed"
LABEL = "label"

# --- fixed values: channels and the prefix their window features carry ---
CHANNELS = ["heart_rate", "breathing_rate", "activity", "cadence"]
FEATURE_PREFIX = {"heart_rate": "HR", "breathing_rate": "BR", "activity": "Act", "cadence": "Cad"}
FEATURES = [
    "HR_mean", "HR_range", "HR_std", "DeltaHR",
    "BR_mean", "BR_std", "DeltaBR",
    "Act_mean", "Act_std", "DeltaAct",
    "Cad_mean", "Cad_std", "DeltaCad",
    "Ratio_DHR_DBR",
]

# --- fixed values: header patterns, null tokens, clock rate of raw recordings ---
HEADER_PATTERNS = {
    "heart_rate": r"\b(heart(_|\s*)rate|hr)\b",
    "breathing_rate": r"\b(breath(ing)?(_|\s*)rate|br)\b",
    "activity": r"\bactivity\b",
    "cadence": r"\bcad(ence)?\b",
    "time_elapsed": r"\b(time(_|\s*)elapsed|time\s*offset|elapsed)\b",
}
NULL_TOKENS = ["", "NA", "N/A", "--", "NaN", "nan"]
TICKS_PER_SECOND = 256
EVENT_TYPE = "fbtcs"

# --- fixed values: windows, folds, post-processing, event scoring ---
WINDOW = 15
STEP = 5
OUTER_FOLDS = 7
INNER_FOLDS = 6
WIDTHS = [4, 6]
THRESHOLDS = [0.40]
FINAL_WIDTH = 6
FINAL_THRESHOLD = 0.40
WEIGHT_BOOST = 10
TOLERANCE_S = 15
ONSET_TOLERANCE_S = 30
MERGE_GAP_S = 240
MAX_EVENT_S = 1000
MAX_SPAN_S = 5_000_000
MAX_SECOND = 10_000_000
MAX_NULL_SHARE = 0.60
DROP_PREFIXES = ["expiration_t-", "inspiration_t-"]
ABSOLUTE_SHARE = 0.8
MAX_FILL_AGE_S = 3
ANCHOR = "2000-01-01 00:00:00"

SIGNAL_SCHEMA = T.StructType(
    [T.StructField("grp", T.StringType()), T.StructField("record", T.StringType())]
    + [T.StructField(TIME, T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in CHANNELS]
    + [T.StructField(LABEL, T.ByteType()), T.StructField("file_pos", T.LongType())]
)

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("ann_key", T.StringType()),
    T.StructField("ann_pos", T.LongType()),
    T.StructField("onset", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("generalization", T.StringType()),
])
