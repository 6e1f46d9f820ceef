"""Spark jobs for voxel frames, point clouds, meshes and flight logs, keyed by scene."""
