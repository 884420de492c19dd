"""Table schemas and the fixed values results depend on (one place)."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: these must stay equal to the original pipeline's -------
# event type -> weight; a missing (null) type is a historical purchase
EVENT_WEIGHTS = {"purchase": 1.0, "add_to_cart": 0.5, "click": 0.1}
NULL_EVENT_WEIGHT = 1.0
UNKNOWN_EVENT_WEIGHT = 0.0
LEARNING_RATE = 0.2
DEBOUNCE_SECONDS = 300
HISTORY_LIMIT = 100
HISTORY_TTL_DAYS = 365
TRENDING_DAYS = 30
TRENDING_K = 50
ARCHIVE_PRICE = 0.03
ARCHIVE_SALES_CHANNEL = 2
ID_WIDTH = 10
IMAGE_CODE_CHARS = 3
SOURCE_TRENDING = "trending_now"
SOURCE_PERSONALIZED = "personalized"
USER_KNOWN = "known"
USER_COLD = "cold_start"
DEFAULT_K = 10
MAX_K = 50
DEFAULT_LAMBDA = 0.8
EXPLAIN_DEFAULT_TOP_K = 3
EXPLAIN_MAX_TOP_K = 10
EXPLAIN_HISTORY = 20
PROFILE_RECENT = 10
PROFILE_TOP_CATEGORIES = 5
UNKNOWN_NAME = "Unknown"
DIVERSITY_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
ALS_PARAMS = dict(rank=32, regParam=0.01, alpha=1.0, maxIter=10,
                  implicitPrefs=True, coldStartStrategy="drop")
ALS_VARIANT_PARAMS = dict(rank=10, regParam=0.1, maxIter=10, implicitPrefs=True,
                          coldStartStrategy="drop", nonnegative=True)
PAYLOAD_COLS = (
    "article_id",
    "prod_name",
    "product_type_name",
    "product_group_name",
    "graphical_appearance_name",
    "index_group_name",
)
# ---------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("user_idx", T.IntegerType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("item_idx", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
])

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("t_dat", T.DateType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("sales_channel_id", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
])

ARTICLE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in PAYLOAD_COLS]
)

VECTOR_TYPE = T.ArrayType(T.FloatType())


def fetch_limit(k: int, diversity_lambda: float) -> int:
    """Candidates to fetch before re-ranking (over-fetch only when MMR runs)."""
    if diversity_lambda >= 1.0:
        return k
    return min(k * 2, k + 20, MAX_K)


def check_args(k: int = DEFAULT_K, explain_top_k: int = EXPLAIN_DEFAULT_TOP_K,
               diversity_lambda: float = DEFAULT_LAMBDA,
               recent_limit: int = PROFILE_RECENT,
               top_categories: int = PROFILE_TOP_CATEGORIES) -> None:
    """Reject out-of-range request arguments at call time."""
    if not (0 < k <= MAX_K):
        raise ValueError(f"k must be in 1..{MAX_K}, got {k}")
    if not (0 < explain_top_k <= EXPLAIN_MAX_TOP_K):
        raise ValueError(f"explain_top_k must be in 1..{EXPLAIN_MAX_TOP_K}")
    if not (0.0 <= diversity_lambda <= 1.0):
        raise ValueError("diversity_lambda must be in [0, 1]")
    if not (0 < recent_limit <= MAX_K):
        raise ValueError(f"recent_limit must be in 1..{MAX_K}")
    if not (0 < top_categories <= EXPLAIN_MAX_TOP_K):
        raise ValueError("top_categories must be in 1..10")
