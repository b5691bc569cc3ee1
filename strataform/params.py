"""Run parameters."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults of a registration run; lengths in metres, angles in degrees."""

    resolution: float = 0.2
    angle_tolerance: float = 3.0
    fac_epsilon: float = 2.0
    fac_tau: float = 2.0
    max_line_num: int = 20
    min_points: int = 3
    threshold_count: int = 1
    max_tilt: float = 30.0
    thetas: int = 180

    @property
    def voxel(self) -> float:
        return 2 * self.resolution

    @property
    def epsilon(self) -> float:
        return self.fac_epsilon * self.resolution

    @property
    def tau(self) -> float:
        return self.fac_tau * self.resolution
