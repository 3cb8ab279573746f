"""Row diff, schema diff and migrations."""
