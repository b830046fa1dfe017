"""Operators for large-scale training-data pipelines. Nothing else in docketspark imports this."""
