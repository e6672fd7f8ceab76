"""Readers and writers of bars, metrics, predictions and file lists."""
