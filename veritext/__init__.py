"""veritext: machine-written review detection as Spark jobs."""

__version__ = "0.1.0"
