"""Training-data preparation: dedup, extraction, scoring, decontamination, mixing."""
