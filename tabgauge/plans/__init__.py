"""Registered queries over the test tables, each with plain SQL where SQL can state it."""
