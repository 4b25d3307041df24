"""loomspark: partitioned classification and table work expressed as Spark jobs."""

__version__ = "0.1.0"
