"""SQL expressions for headers, type names, identifiers and keys.

Every function takes and returns the text of a Spark SQL expression, so that they nest freely,
also inside the lambdas of higher-order functions, and a whole expression reaches the engine
with one call: ``F.expr(canonical_type("logical_type"))``.
"""
