"""Pipelines over unbounded inputs."""
