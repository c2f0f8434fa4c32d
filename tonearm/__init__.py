"""Media-library analytics on Spark: DataFrame plans for identity, matching, grouping, similarity and playlists."""

__version__ = "0.1.0"
