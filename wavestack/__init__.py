"""Waveform stacking, triggering and location as composable Spark DataFrame transformations."""
