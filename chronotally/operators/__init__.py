"""Stages that derive tables from the event stream."""
