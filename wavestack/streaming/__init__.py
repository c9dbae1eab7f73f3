"""streaming of the wavestack engine."""
