"""Sources: CSV/Parquet ingest with column contracts, and the fixture adapter."""
