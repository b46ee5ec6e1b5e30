"""Calibration of the estimator and the decoder by simulation."""
