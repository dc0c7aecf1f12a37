"""Text-encoding analytics on Spark: byte payloads in, ranked encodings, noise scores and text profiles out."""

__version__ = "0.1.0"
