"""Scoring as a stream. Each payload is scored by itself: there is no state, no watermark, no window."""
