"""Readers and checks of what a survey delivers."""
