"""How work on one space is dealt out over tasks."""
