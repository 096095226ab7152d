"""Parameters of the registered queries (fixed so the SQL oracle can repeat them)."""

from datetime import datetime

# interval baseline and detection
BASELINE_START = datetime(2024, 1, 1, 0, 0, 0)
BASELINE_END = datetime(2024, 1, 21, 23, 45, 0)        # inclusive spine end, 2016 points
DETECT_START = datetime(2024, 1, 22, 0, 0, 0)
DETECT_END = datetime(2024, 1, 31, 0, 0, 0)            # exclusive
MIN_TOTAL = 100
CUT_START = datetime(2024, 1, 5, 6, 15, 0)             # a range that cuts its first and last day
CUT_END = datetime(2024, 1, 18, 17, 30, 0)
RESTATED_DAY = "2024-01-10"                            # a day that is landed again without one quad class
RESTATED_WITHOUT = "1"
Z_LIMIT = 3.0
METRIC_COLUMNS = ["event_root_code", "quad_class"]
LOG_START = datetime(2024, 1, 1, 0, 0, 0)              # interval log coverage [start, end)
LOG_END = datetime(2024, 1, 31, 0, 0, 0)

# actor-pair conflicts
AS_OF = "20000615"
DAYS = 1
THRESHOLD = 0.5
PAIR = ("NATION_3", "NATION_7")
PAIR_CODE = "05"
PAIR_RECENT_DAYS = 30

# graph exploration
ACTOR = "NATION_3"
RECENT_K = 15
TOP_K = 5

# a time after every event, which closes all windows of a stream
FAR_AHEAD = datetime(2030, 1, 1, 0, 0, 0)

# tracked terms over documents, in priority order
TERMS = ["zzzz", "the", "und", "para", "pour"]
# the same and phrases, for the first-word index
INDEXED_TERMS = TERMS + ["THE", "in the", "und die", "of the", "that the and", "license", "copyright"]
FIRST_K = 5

# calendar for the day backfill
MONTH_FIRST = "2024-01-01"
MONTH_LAST = "2024-01-31"

ROUND = 6
