"""stackroom: analytics over document libraries, written as Spark plans."""

__version__ = "0.1.0"
