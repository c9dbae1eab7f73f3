"""sources of the wavestack engine."""
