"""Part of turnloom."""
