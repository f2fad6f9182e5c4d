"""Near-duplicate text fingerprinting as DataFrame plans."""

__version__ = "0.1.0"
