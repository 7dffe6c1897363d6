"""Spoken-formula analytics on Spark."""
