"""Ranking analytics, ordered text streams, dynamic values, codecs and graph queries on Spark DataFrames."""
