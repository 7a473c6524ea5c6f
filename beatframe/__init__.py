"""Waveform event analytics as Spark DataFrame operators.

``beatframe.plans.detect.analyze_traces`` runs the whole analysis; the operators
it is made of live in ``beatframe.operators`` and can be used on their own.
"""

from .params import DETECTOR, REVIEW, DetectorParams, ReviewParams

__all__ = ["DETECTOR", "REVIEW", "DetectorParams", "ReviewParams"]
