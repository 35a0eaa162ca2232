"""Streaming forms of the series inputs."""
