"""Operators of a training-data pipeline. Nothing else in netquill imports this."""
