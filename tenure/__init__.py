"""tenure: subscriber analytics on Spark.

Cleaned, typed tables -> activity, recency, content-mix, trend and calendar-lag
features -> quantile and rule segments -> data quality, leakage and hypothesis
tests -> churn and purchase models, metrics and gate -> batch scoring.

Every operator is a function from DataFrames to a DataFrame written with the
Spark DataFrame API; nothing is collected except per-column statistics.
"""

__version__ = "0.1.0"
