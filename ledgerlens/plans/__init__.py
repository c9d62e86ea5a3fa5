"""Plans: the full scan, report rollups, sinks, and the registered queries."""
