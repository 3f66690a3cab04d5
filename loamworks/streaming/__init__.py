"""Streams of deliveries."""
