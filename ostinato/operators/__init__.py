"""Operators on ordered, time-stamped sequences: DataFrame in, DataFrame out."""
