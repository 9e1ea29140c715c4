"""Streams: windowed usage with watermarks."""
