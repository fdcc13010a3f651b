"""errorlab: text-error analytics as Spark DataFrame operators.

Sub-packages
------------
functions  Column -> Column expressions (hash RNG, tokenizer, corruption steps,
           fixed-width windows, decision rules).  All built-in Spark expressions.
operators  DataFrame -> DataFrame operators, one module per family of SURVEY §2.
sources    readers and writers (S1-S16).
streaming  Structured Streaming variants (Z1-Z4).
plans      fixtures derived from the driver tables and the query catalog used by
           ``__spark_entry__``.
"""

__version__ = "0.1.0"
