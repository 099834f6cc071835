"""Files, managed tables and catalogue listings."""
