"""Constants of the rating model."""

from __future__ import annotations

from dataclasses import dataclass

# These must be what they are for right results.
TIME_ZONE = "Asia/Shanghai"
SAFETY_FACTOR = 0.8
MAX_TEMP = 80.0
INTERVAL_MINUTES = 30
BOUNDS = {"wind_speed": (0.0, 75.0), "ambient_temp": (-60.0, 70.0)}
DEFAULTS = {"solar_radiation": 0.0, "humidity": 50.0, "elevation": 1000.0}
HEAT_CAPACITY = {"aluminum": 955.0, "copper": 423.0, "steel": 476.0, "aluminum_clad_steel": 534.0}
CLEAR_SKY = (-42.2391, 63.8044, -1.9220, 3.46921e-2, -3.61118e-4, 1.94318e-6, -4.07608e-9)
SOLAR_ELEVATION = (1.0, 1.148e-4, -1.108e-8)
CONDUCTORS = {
    "4×JL/G1A-630/45": {
        "D0": 0.0338, "R_low_25": 4.680e-5, "R_high_75": 5.830e-5, "R_high_200": 8.740e-5,
        "materials": (("aluminum", 1.701), ("steel", 0.350)),
        "area_m2": 6.75e-4, "elastic_modulus_pa": 7.0e10, "thermal_expansion_per_c": 19.6e-6,
        "mass_per_length_kg_m": 2.051,
    },
    "ACSR Drake (795 kcmil)": {
        "D0": 0.0281, "R_low_25": 7.283e-5, "R_high_75": 8.688e-5, "R_high_200": 1.220e-4,
        "materials": (("aluminum", 1.116), ("steel", 0.5126)),
        "area_m2": 4.685e-4, "elastic_modulus_pa": 7.0e10, "thermal_expansion_per_c": 19.1e-6,
        "mass_per_length_kg_m": 1.6286,
    },
}
GRAVITY = 9.80665
EARTH_RADIUS_M = 6371008.8
SAG = {
    "min_angle_deg": 0.05, "max_angle_deg": 89.5, "reference_temp_c": 20.0, "reference_tension_n": 20000.0,
    "span_m": 300.0, "elastic_modulus_pa": 7.0e10, "area_m2": 6.75e-4, "thermal_expansion_per_c": 1.9e-5,
    "base_threshold_c": 5.0, "recovery_ratio": 0.6, "recovery_samples": 3, "recovery_alpha": 0.25,
    "convergence_a": 1.0, "history": 12, "unit_mass_kg_m": 1.0,
}


@dataclass(frozen=True)
class Conductor:
    """One conductor, with what its surface takes up and gives off."""

    diameter: float
    r25: float
    r75: float
    r200: float
    materials: tuple[tuple[str, float], ...] = ()
    emissivity: float = 0.8
    absorptivity: float = 0.8
    max_temp: float = MAX_TEMP

    @classmethod
    def named(cls, name: str, **changes: float) -> Conductor:
        c = CONDUCTORS[name]
        return cls(c["D0"], c["R_low_25"], c["R_high_75"], c["R_high_200"], c["materials"], **changes)

    @property
    def heat_capacity(self) -> float:
        """J / (m K)."""
        return sum(mass * HEAT_CAPACITY[kind] for kind, mass in self.materials)


@dataclass(frozen=True)
class Correction:
    """Options of the local weather correction."""

    ref_height_m: float = 10.0
    line_height_m: float = 20.0
    roughness_alpha: float = 0.15
    temp_lapse_rate: float = 0.0065
    ground_albedo: float = 0.35
    ground_temp_offset: float = 0.0
    line_azimuth_deg: float = 90.0
    vertical: bool = True
    terrain: bool = True
    desert: bool = False
    direction: bool = True
