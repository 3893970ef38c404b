"""Session settings, the full analysis run, and plan inspection."""
