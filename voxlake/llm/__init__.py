"""Operators of a training-data pipeline, one module each. Nothing else in voxlake imports this subpackage."""
