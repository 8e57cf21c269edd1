"""Structured Streaming operators: bar building, de-duplication, running indicators, alerts, upserts."""
