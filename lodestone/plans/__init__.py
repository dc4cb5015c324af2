"""The predicate language, sort specifications, cardinality estimates, queries."""
