"""Code-posture analytics as Spark jobs: rules over source files, and everything built on findings."""

__version__ = "0.1"
