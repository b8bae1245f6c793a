"""Query plans: the driver query registry, its SQL oracles, the end-to-end job."""
