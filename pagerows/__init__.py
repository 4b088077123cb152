"""Spark library that turns web pages, sheets and chat logs into clean, enriched rows."""
