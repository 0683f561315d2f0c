"""Operators: features (C/D), scenarios (B), forest (E), evaluate (F),
sweep (E1-E2, G) and checks (H)."""
