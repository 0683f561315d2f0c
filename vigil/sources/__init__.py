"""Sources and sinks: activity tables (A1-A3) and run tables."""
