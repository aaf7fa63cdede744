"""Default parameters of the reference analyses.

Fixed values (must equal the reference's for matching results):
- order statuses excluded from every customer analysis: canceled, unavailable
- Q4 minimum distinct orders per category (HAVING > 100) and top-k 15
- D3 minimum first-time customers per category (HAVING >= 500)
- D4 cohort cutoff month 2017-01-01
- D6 "just on time" window: 3 days before the estimate
- M6 number of retained categories: 15
- T4 target recalls 0.60, 0.30, 0.10 and their actions
- model seeds 42, test fraction 0.2
"""

EXCLUDED_STATUSES = ("canceled", "unavailable")
Q4_MIN_ORDERS = 100
Q4_TOP_K = 15
D3_MIN_CUSTOMERS = 500
D4_COHORT_CUTOFF = "2017-01-01"
D6_JUST_ON_TIME_DAYS = 3
TOP_CATEGORIES = 15
LOW_REVIEW_MAX = 2
TEST_FRACTION = 0.2
SEED = 42

RECALL_TARGETS = (
    ("Email nudge (near-zero cost)", 0.60),
    ("Discount code (moderate cost)", 0.30),
    ("VIP perk / outreach (high cost)", 0.10),
)
