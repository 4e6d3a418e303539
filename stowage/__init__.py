"""stowage: file inventories, duplicate detection and copy plans on Spark."""
