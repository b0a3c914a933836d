"""Session helpers and plan inspection."""
