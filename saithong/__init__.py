"""Saithong: Spark-native text analytics for Thai and mixed-language corpora."""
