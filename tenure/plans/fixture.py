"""Parameters that map the reference's setting onto the driver's tables.

The reference analyses calendar 2023 with a fixed as-of date at its end and a
per-month keyword list; on the driver's data the orders span 1995-2001, so the
analysis year is 1998.
"""

from __future__ import annotations

YEAR_START = 199801
YEAR_END = 199812
REF_DATE = "1998-12-31"      # recency as-of date (end of the analysis year)
NO_EVENT_RECENCY = 999       # recency for users without any dated event
KPI_MONTH = 199812           # one-month snapshot
# Keyword table of the fixture (month, keyword); titles are two
# words such as 'red widget', matched after removing spaces.
KEYWORDS = [(199801, "widget"), (199802, "gear"), (199803, "bolt")]
SEED = 42
