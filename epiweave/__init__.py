"""Surveillance analytics over panels of weekly series, line lists, report corpora and ledgers, on Spark."""
