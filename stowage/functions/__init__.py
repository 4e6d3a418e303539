"""Column functions; all of them stay inside Catalyst expressions."""
