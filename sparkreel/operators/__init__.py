"""Relational operators over frames, tracks, cues, layers and samples."""
