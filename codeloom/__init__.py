"""codeloom: source-code analytics expressed as Spark DataFrame jobs.

Files become rows, tokens become rows, definitions are found with windows over
token rows, and every search / fold / statistic is a DataFrame plan that
Catalyst optimises.  No custom Catalyst rules, no driver-side loops.
"""

__all__ = ["session", "schemas"]
