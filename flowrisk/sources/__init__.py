"""Reading raw logs and writing canonical tables."""
