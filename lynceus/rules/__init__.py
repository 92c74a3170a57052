"""Rule catalogs, kept as data."""
