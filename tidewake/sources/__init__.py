"""Frames, the record log, the archive and the state and track tables."""
