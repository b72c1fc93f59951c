"""Nimbora: forecast and observation analytics as Spark DataFrame operators."""
