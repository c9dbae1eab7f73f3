"""functions of the wavestack engine."""
