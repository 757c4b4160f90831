"""Trajectories as streams."""
