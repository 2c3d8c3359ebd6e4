"""Part of eventloom."""
