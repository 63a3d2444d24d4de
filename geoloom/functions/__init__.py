"""Part of geoloom."""
