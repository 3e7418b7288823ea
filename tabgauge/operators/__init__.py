"""Dataset, trial, scoring and result-table operators."""
