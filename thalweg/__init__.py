"""thalweg: river-network, terrain and corpus analytics as Spark plans."""

__version__ = "0.1.0"
