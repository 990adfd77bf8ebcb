"""Where intermediate tables live, and the driver-facing query plans."""
