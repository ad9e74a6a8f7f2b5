"""Ledgerwright: invoice-document analytics as Spark DataFrame operators."""
