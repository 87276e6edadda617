"""Operators for preparing training text: scanning, scoring, cleaning, joining, mixing and packing documents."""
