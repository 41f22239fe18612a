"""manyfold: many-against-many similarity, clustering and hierarchy analytics as lazy PySpark DataFrame operators."""

__version__ = "0.2"
