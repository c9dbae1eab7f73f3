"""What can go wrong, by stage."""


class WavestackError(Exception):
    """Base of all errors of this library."""


class ConfigError(WavestackError, ValueError):
    """A setting is missing, of the wrong kind, or contradicts another."""


class ArchiveError(WavestackError):
    """The archive has no file, or an unknown layout."""


class DataGap(WavestackError):
    """No usable samples in the wanted span."""


class DataAvailability(WavestackError):
    """Samples exist, but no onset passes the quality checks."""


class TravelTimeError(WavestackError):
    """A travel-time table lacks a station, phase or node, or two tables do not go together."""


class MagnitudeError(WavestackError):
    """Amplitudes or magnitudes cannot be formed."""
