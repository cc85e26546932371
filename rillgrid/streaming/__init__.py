"""Masks that arrive over time: the done-filter and resume of the batch pipeline as a stream."""
