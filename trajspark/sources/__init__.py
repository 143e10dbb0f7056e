from .trajectories import as_trajectories, read_trajectories, trajectory_summary, validate, with_gradient_velocity

__all__ = ["as_trajectories", "read_trajectories", "trajectory_summary", "validate", "with_gradient_velocity"]
