"""fernbrand: a PySpark-native engine for wildland-fire weather, spread and sensor data."""

__version__ = "0.1.0"
