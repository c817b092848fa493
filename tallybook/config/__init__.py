"""Chart of accounts, rules and ingestion settings."""
