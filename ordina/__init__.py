"""ordina: ordered sequences, graphs, points and event logs as Spark DataFrame plans."""

__version__ = "0.1.0"
