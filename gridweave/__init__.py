"""A PySpark-native engine for georeferenced grids, and operators for text corpora in ``llm``."""
