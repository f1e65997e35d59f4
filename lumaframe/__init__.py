"""lumaframe: DataFrame operators for camera-sensor and media time-series data."""

__version__ = "0.1.0"
