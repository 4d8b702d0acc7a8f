"""shelfmark: retail analytics as Spark DataFrame functions.

raw tables -> star schema -> business marts -> report queries.
"""
