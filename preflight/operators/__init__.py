"""DataFrame-in, DataFrame-out operators: checks, grading, lineage,
edge-case assertions, verdicts and report shapes."""
