"""Table-level operators: rule evaluation, profiling, calibration, reports, repairs and gates."""
