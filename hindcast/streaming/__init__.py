"""Structured Streaming forms of the ingest and state operators (S1, S2, S4-S6,
ST1-ST3, ST7, ST8)."""
