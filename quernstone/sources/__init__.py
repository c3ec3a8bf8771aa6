"""Sources, sinks, scratch tables and session settings."""
