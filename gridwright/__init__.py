"""Gridwright: graph analytics over gridded data, written for Spark."""
