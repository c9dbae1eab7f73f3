"""plans of the wavestack engine."""
