"""Operators for preparing training text: cleaning, deduplication, decontamination, mixing and audits."""
