"""operators of the wavestack engine."""
