"""Query registry and physical-plan inspection."""
