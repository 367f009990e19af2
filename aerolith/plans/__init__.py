"""Named queries over the parquet tables, with their SQL oracles."""
