"""Findings and corpus-quality operators for Spark.

Everything is a DataFrame-to-DataFrame function: a corpus becomes a line table
``(file_id, line_no, line)``, rules are column expressions over it, and reports are joins and
aggregations of the results.
"""
