"""Spark analytics for labelled 3D volumes, and operators for preparing training corpora."""
