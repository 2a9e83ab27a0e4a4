"""From raw files and tables to the token, text and segment tables."""
