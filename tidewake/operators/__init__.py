"""DataFrame operators: ingest, state, track, proximity, fleet reports, quality, retention."""
