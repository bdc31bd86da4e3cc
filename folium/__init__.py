"""folium: a Spark-native engine for document retrieval analytics and corpus processing."""

__version__ = "0.1.0"
