"""Copy plans: building, editing, checking and the trash log."""
