"""Column-level functions: time arithmetic, text scalars, patterns, classifiers.

Everything here returns ``pyspark.sql.Column`` expressions built from built-in
functions, so it stays inside whole-stage code generation (no Python UDFs).
"""
