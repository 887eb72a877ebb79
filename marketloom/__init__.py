"""Marketloom: DataFrame operators for transaction markets on Spark."""
