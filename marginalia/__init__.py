"""Triage, label and summarise tables of short texts on Spark."""
